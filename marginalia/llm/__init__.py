"""Operators for preparing training text: archives, language, toxicity, deduplication, mixing, shards, counts.

Each module holds one operator with a general interface; ``queries`` applies them to the given tables.
Nothing outside this subpackage imports it.
"""
