"""Spectral analytics on PySpark."""
