"""Spark-native analytics for text corpora, retrieval and interaction logs."""
