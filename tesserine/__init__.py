"""Tesserine: full-text search, search analytics and corpus preparation on Spark DataFrames."""
