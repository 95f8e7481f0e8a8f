"""Incremental decoding with Structured Streaming."""
