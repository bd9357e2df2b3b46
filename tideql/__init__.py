"""Metrics analytics on Spark: a compact series language compiled to DataFrame plans."""
