"""Spark-native curation and evaluation of multi-source measurement tables."""
