"""Operators over sequence graphs."""
