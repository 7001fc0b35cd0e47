"""Composed plans, join helpers and the query registry."""
