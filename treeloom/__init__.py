"""Spark-native probabilistic tree models: information measures, dependency trees, inference and mixtures."""
