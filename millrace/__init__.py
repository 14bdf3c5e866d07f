"""Millrace: corpus curation, interleaving, sampling and evaluation on Spark DataFrames."""
