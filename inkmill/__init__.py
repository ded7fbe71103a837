"""Spark-first analytics for document-quality and judgement data."""

__version__ = "0.1.0"
