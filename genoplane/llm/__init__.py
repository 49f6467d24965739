"""Training-data operators: dedup, packing, scoring, filtering, extraction.

Nothing outside this subpackage imports it.
"""
