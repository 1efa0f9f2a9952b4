"""Training-data operators: tokenising, deduplication, filtering, search, scoring and sharding of text.

Nothing outside this subpackage imports it.
"""
