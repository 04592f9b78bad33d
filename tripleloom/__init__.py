"""Spark-native canonicalisation and analytics of typed triplets."""

__version__ = "0.1.0"
