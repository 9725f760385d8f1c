"""Robust, distribution-free data analysis on Spark DataFrames."""
