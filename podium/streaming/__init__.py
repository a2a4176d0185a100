"""Structured Streaming forms of the boards."""
