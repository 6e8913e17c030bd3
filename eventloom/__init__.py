"""Spark-native analytics over collections of event pages, feeds and link lists."""
