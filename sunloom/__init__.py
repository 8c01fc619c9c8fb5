"""Spark-native analytics for regular-interval series."""
