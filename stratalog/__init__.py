"""Spark-native log structuring and analytics."""
