"""Spark-native variant annotation analytics."""
