"""Shelfmark: catalogue matching and selection on Spark DataFrames."""
