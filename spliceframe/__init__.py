"""Spark-native transcript-abundance analytics."""
