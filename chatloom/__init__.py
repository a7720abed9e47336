"""Spark-native preparation and analysis of conversational training data."""
