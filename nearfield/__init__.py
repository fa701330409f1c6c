"""Similarity search, vector indexes and corpus preparation on PySpark."""
