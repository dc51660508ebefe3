"""Operators on generic columns."""
