"""Tideglass: a Spark-native engine for social-signal analytics."""

__version__ = "0.1.0"
