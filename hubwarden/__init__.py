"""Audit engine for machine-learning supply chains, built on Spark DataFrames."""

__version__ = "0.1.0"
