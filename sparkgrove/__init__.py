"""Spark-native search over source code and text collections."""
