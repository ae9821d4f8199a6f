"""Incremental processing of run files as they arrive (Structured Streaming)."""
