"""Statements as DataFrames."""
