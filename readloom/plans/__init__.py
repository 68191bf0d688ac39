"""Queries and tasks composed of operators."""
