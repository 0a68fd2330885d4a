"""Relational operators over datasets, each a function on DataFrames."""
