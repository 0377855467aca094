"""Elevation analytics on Spark DataFrames."""
