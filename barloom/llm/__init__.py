"""Operators for preparing training text at scale: privacy, quality, dedup, mixing, language and URL filters."""
