"""Spark-native operators for evidence-backed opportunity data."""
