"""Compilation of definitions to Spark plans."""
