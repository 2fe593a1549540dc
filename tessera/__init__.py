"""Tessera: a Spark-native analytics engine for text-memory corpora."""

__version__ = "0.1.0"
