"""Operators for preparing training text: formatting, dedup, quality, tokens, packing."""
