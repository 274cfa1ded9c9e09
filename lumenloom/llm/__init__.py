"""Operators for large text corpora: dedup, search, quality, packing, tokens, archives."""
