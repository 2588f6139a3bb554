"""Operators for preparing training text: filters, near-duplicates, mixing, packing, archives and extraction.

Nothing outside this package imports it.
"""
