"""Operators over facts and edges; each is a function of DataFrames."""
