"""Incremental arrival of segments."""
