"""Training-data operators: counting, dedup, packing, filtering, mixing and scanning of text tables.

Every operator is a function from DataFrames to a DataFrame. They select the columns they need
before doing anything else, so extra columns of the input, whatever their names, never clash with
working or result columns.
"""
