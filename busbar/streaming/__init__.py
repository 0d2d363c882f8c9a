"""Structured Streaming queries over live readings."""
