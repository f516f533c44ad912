"""Tidemark: lakehouse analytics operators written for Spark's DataFrame API."""
