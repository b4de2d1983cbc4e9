"""Comparable-based valuation of listings on Spark DataFrames."""
