"""Spark-native curation, evaluation and stream analytics for text corpora."""

__version__ = "0.1.0"
