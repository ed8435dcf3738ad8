"""Spark-native change-coupling, range-drift and session analytics."""
