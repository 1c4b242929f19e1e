"""Spark-native narration analytics: books as tables, every analysis a DataFrame transform."""
