"""Training-data operators: deduplication, filtering, mixing, formatting and packing.

Nothing outside this subpackage imports it. Every operator takes and returns
DataFrames; ``queries`` binds them to whole tables.
"""
