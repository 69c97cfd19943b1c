"""Queries by name, with SQL for the same results."""
