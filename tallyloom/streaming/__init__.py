"""Structured Streaming versions of the running statistics."""
