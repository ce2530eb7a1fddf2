"""Whole imports composed from the operators, and the queries on the given tables."""
