"""Training-data operators: filtering, near-duplicates, packing, search and tokenisation.

Nothing outside this package imports it; it can be removed without touching the rest.
"""
