"""Containers in and out of DataFrames."""
