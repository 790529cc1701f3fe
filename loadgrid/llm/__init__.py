"""Operators that prepare text corpora, each a function from DataFrames to a DataFrame."""
