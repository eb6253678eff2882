"""Tessera: hybrid retrieval and data preparation over labelled media collections, on Spark DataFrames."""
