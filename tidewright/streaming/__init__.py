"""Structured Streaming over arriving runs."""
