"""Incremental indexing, batch and Structured Streaming."""
