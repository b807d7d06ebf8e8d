"""Traversals as step lists, and their compilation to DataFrames."""
