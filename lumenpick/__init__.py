"""Spark-first analytics for choosing the best images of a large collection."""
