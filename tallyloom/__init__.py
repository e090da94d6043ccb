"""Spark-native corpus scoring, de-duplication and curation."""
