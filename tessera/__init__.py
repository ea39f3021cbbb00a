"""Spark-native text-corpus and training-data engine."""
