"""Readers and writers of graphs, queries and results."""
