"""Spark-native analytics over durable job and workflow ledgers."""
