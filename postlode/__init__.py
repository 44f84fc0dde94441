"""Spark-native engine for ranking semi-structured text postings."""
