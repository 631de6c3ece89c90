"""Spark-native analytics over sequence alignments."""
