"""Relational feature building on Spark DataFrames."""
