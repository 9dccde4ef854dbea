"""Spark-native analytics for pixel grids, feature vectors and their learners."""
