"""Tidemark: a PySpark-native engine for revenue-data quality and training-data preparation."""

__version__ = "0.1.0"
