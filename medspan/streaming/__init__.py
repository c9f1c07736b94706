"""Streaming forms of interval merging and fixed windows."""
