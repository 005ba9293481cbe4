"""Spark-native corpus curation and evaluation analytics."""

__version__ = "0.1.0"
