"""Spark-native analytics over street recordings: signs, scene graphs, tracks and retrieval."""

__version__ = "0.1.0"
