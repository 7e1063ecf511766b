"""Spark-native legal-citation analytics."""
