"""Structured Streaming forms of the append-only logs and the upserts."""
