"""Training-data operators: filters, deduplication, sharding, tokens, mixing.

Nothing outside this subpackage imports it.
"""
