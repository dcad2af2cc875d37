"""Operators that iterate or need Arrow batches."""
