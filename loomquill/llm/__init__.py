"""Training-data operators: dedup, scoring, packing, search and tokenisation on DataFrames.

Nothing outside this folder imports it.
"""
