"""Tempestry: Spark-native analytics for daily panels, event snapshots and texts."""
