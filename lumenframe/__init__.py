"""Spark-native quantitative imaging analytics and training-data operators."""

__version__ = "0.1.0"
