"""Catalog analytics on Spark DataFrames."""
