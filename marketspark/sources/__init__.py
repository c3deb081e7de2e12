"""Readers, writers and adapters of the test tables."""
