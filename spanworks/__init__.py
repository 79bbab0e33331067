"""Spark-native span retrieval, change-impact analysis and corpus preparation."""
