"""Readers and writers of graph files, and generators of graphs."""
