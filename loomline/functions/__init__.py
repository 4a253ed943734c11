"""Scalar functions: durations, text extraction, timestamps, hashes."""
