"""Spark-native analytics of media-asset libraries."""
