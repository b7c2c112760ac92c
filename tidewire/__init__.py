"""Spark-native news factor, ranking and data-preparation engine."""
