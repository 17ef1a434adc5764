"""Spark-native evaluation of tool-calling agents: lint, score, compare, trace, generate."""
