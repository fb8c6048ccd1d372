"""Structured Streaming variants of the two incremental operators."""
