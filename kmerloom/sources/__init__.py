"""Readers and writers of graphs, variants and sequences."""
