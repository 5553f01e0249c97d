"""Spark-native document retrieval and text-data engine."""
