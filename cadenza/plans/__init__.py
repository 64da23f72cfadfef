"""Queries over stored tables, with the same in SQL."""
