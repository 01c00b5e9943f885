"""Structured Streaming jobs and incremental batch."""
