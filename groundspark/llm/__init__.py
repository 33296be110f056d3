"""Training-data operators: thirteen corpus-scale transformations, each a function of DataFrames.

Nothing outside this subpackage imports it; its queries and SQL are in `queries.py`.
"""
