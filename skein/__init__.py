"""Retrieval, transcript and text analytics as PySpark DataFrame operators."""
