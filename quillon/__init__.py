"""Quillon: a Spark-native engine for bounded, typed questions about text and JSON."""
