"""Structured Streaming forms of the aggregations."""
