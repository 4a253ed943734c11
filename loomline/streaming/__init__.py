"""Structured Streaming: real-time joins, deduplication, windows, metrics."""
