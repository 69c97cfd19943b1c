"""Spark-native site contact resolution over captured pages."""
