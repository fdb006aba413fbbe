"""Spark-native analytics over content-screening tables."""
