"""Spark-native site-frequency analytics."""

__version__ = "0.1.0"
