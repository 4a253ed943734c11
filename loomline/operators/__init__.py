"""Operators that turn events into correlations."""
