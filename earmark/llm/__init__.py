"""Operators for preparing training data at scale: near-duplicates, tokens, filters, mixing.

Each module holds one operator; ``queries`` registers them over the given
tables. Nothing outside this package imports it.
"""
