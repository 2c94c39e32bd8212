"""Spark operators for the data work around supervised learning on large tables."""
