"""Structured Streaming into the key-value log."""
