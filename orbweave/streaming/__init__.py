"""Structured Streaming over temporal edges."""
