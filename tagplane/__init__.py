"""Spark-native analytics over paired-tag interaction data."""
