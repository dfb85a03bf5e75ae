"""Structured Streaming variants of the incremental tables."""
