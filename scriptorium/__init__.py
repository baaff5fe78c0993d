"""Spark-native text-evaluation engine."""
