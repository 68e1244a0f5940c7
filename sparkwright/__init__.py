"""Spark-native analytics over relational code models, findings and their evaluation."""
