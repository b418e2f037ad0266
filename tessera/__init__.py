"""Spark-native multi-view geometry analytics."""
