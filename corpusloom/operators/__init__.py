"""Relational, text-search, vector and reference operators."""
