"""Supplier-intelligence analytics expressed as Spark DataFrames."""
