"""Tessera: analytics over media metadata and text corpora, on Spark DataFrames."""
