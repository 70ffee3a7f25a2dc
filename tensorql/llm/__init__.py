"""Operators for preparing training text: deduplication, packing, encoding, filtering.

Nothing else in the library imports this subpackage; it can be removed whole.
"""
