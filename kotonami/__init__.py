"""Spark-native Japanese lexical analytics over captured payload tables."""
