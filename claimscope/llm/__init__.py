"""Operators that prepare training text: language, quality, duplicates, mixing, packing."""
