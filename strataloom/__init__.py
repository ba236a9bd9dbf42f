"""Spark-native knowledge retrieval, graph analytics and corpus engine."""

__version__ = "0.1.0"
