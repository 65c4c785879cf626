"""Spark-native evaluation, reward and curation analytics."""
