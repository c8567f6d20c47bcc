"""Geodetic analytics on PySpark, and operators for text corpora."""
