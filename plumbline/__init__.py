"""Leakage-aware benchmark analytics on Spark DataFrames."""
