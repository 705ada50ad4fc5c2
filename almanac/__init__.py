"""Almanac: a Spark-native knowledge-base analytics engine."""
