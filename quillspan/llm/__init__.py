"""Operators for preparing training text: filtering, deduplication, mixing, encoding, archives."""
