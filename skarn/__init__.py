"""Skarn: a PySpark-native engine for retrieval, evaluation and corpus analytics."""
