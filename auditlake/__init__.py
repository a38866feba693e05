"""Exposure-audit analytics on Spark DataFrames."""
