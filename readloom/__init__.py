"""Consensus reconstruction of clustered noisy reads, and its evaluation, on Spark DataFrames."""
