"""Spark-native price intelligence, entity resolution and corpus preparation."""
