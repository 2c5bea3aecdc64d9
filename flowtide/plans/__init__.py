"""Composed plans and the query catalog over the given tables."""
