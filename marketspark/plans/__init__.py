"""Workflows that combine operators."""
