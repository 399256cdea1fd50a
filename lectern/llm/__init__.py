"""Training-data operators: thirteen large-scale corpus operations on DataFrames.

Nothing outside this subpackage imports it; ``registry`` holds its queries.
"""
