"""Spark-native analytics over large collections of small typed concept graphs."""
