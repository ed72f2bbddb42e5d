"""Spark-native quantity pricing and tender analytics."""
