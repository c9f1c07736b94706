"""Operators on row-sets keyed by the context."""
