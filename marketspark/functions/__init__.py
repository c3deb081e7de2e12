"""Scalar functions: column expressions, all built-in."""
