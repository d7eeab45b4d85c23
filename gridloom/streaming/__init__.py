"""Means over files that keep arriving."""
