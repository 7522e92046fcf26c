"""Spark-native SQL pipeline and analytics engine."""
