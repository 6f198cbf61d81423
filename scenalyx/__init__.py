"""Scenario analytics for panel time series on Spark DataFrames."""

__version__ = "0.2.0"
