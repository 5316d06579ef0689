"""Operators bound to the given tables, each with the same result stated in plain SQL."""
