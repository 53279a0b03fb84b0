"""Operators for preparing training text: near-duplicates, filters, mixing and packing."""
