"""Spark-native search, retrieval and text-data analytics."""

__version__ = "0.1.0"
