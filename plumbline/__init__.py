"""Paired-experiment and code-graph analytics on Spark."""
