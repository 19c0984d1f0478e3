"""Scans of the tables the queries read."""
