"""Faceted document search and corpus preparation on Spark DataFrames."""
