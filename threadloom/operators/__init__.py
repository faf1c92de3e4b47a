"""Analyses over archive tables, each a function of DataFrames."""
