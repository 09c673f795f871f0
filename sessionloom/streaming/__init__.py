"""Structured Streaming ingest and running statistics."""
