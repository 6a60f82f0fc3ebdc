"""Spark-native analytics for capacity-limited shared-mobility networks."""
