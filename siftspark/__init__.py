"""Spark-native catalogue, keyword, semantic and hybrid file search."""
