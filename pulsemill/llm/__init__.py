"""Operators for preparing training text: dedup, filters, tokens, shards.

Nothing outside this package imports it.
"""
