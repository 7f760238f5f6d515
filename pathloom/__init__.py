"""Spark-native analytics for sparse, noisy location traces on a road graph."""
