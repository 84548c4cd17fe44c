"""Spark-native document compilation and quality analytics."""
