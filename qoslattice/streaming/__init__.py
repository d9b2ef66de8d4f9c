"""Structured Streaming ingest (an extension of the batch operators)."""
