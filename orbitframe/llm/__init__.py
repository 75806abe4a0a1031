"""Operators for preparing training data: deduplication, extraction, filtering, mixing, packing.

Nothing else in the library imports this subpackage.
"""
