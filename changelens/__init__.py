"""Spark-native analytics for database operations data."""
