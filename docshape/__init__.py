"""Relational data in nested form, on Spark."""
