"""Spark-native data protection engine: detect, mask, apply and validate."""
