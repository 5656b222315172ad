"""Quire: document analytics on PySpark."""
