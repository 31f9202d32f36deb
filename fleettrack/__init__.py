"""Vessel-track analytics on Spark DataFrames."""
