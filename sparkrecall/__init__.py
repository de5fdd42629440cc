"""Spark-native analytics over agent memories and text corpora."""
