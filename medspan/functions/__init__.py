"""Operators on typed SQL expressions, by family."""
