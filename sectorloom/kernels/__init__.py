"""Byte-level parsing and building, free of Spark."""
