"""Spark-native engine for code property graphs and the texts around them."""
