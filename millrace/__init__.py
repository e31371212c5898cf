"""Spark-native engine for reconciling semi-structured documents and preparing text at scale."""
