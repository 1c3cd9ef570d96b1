"""Analyses of signals, each a function from DataFrames to DataFrames."""
