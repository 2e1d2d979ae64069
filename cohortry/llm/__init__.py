"""Operators of a training-data pipeline over text tables.

Each module holds one operator as a function from DataFrames to a DataFrame; ``queries`` applies
them to the sample tables. Nothing outside this folder imports it.
"""
