"""Operators for preparing training text: filtering, deduplication, encoding, packing and archives."""
