"""Structured Streaming variants of checks and measures."""
