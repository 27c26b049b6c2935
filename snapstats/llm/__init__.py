"""Training-data operators: deduplication, filtering, packing and placement of text.

Nothing outside this subpackage imports it.
"""
