"""Structured Streaming sessions."""
