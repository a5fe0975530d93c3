"""A Spark-native engine for tagging, indexing and preparing text corpora."""
