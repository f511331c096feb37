"""Lodestrata: evidence retrieval, dataset preparation and evaluation on Spark DataFrames.

Operators take DataFrames and return DataFrames. Nothing is collected to the driver unless the
docstring names the bound of what comes back.
"""
