"""Training-data operators: search, mixing, tokenizing, privacy, extraction, filtering and deduplication.

Nothing outside this subpackage imports it.
"""
