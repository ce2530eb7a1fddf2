"""Uploads that arrive over time."""
