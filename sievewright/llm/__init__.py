"""Training-data operators: near-duplicates, extraction, archives, packing.

Nothing outside this subpackage imports it.
"""
