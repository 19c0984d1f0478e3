"""Strandline: evidence and interval analytics on PySpark."""
