"""Spark-native similarity, near-duplicate and provenance analytics."""
