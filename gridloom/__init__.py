"""Spark-first N-dimensional arrays, and the data work around them."""
