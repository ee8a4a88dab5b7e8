"""Readers for the given tables."""
