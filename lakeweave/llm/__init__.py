"""Operators for building training corpora: mixing, deduplication, sharding, tokens, packing, filtering, archives."""
