"""Preparation of training data: splits, nearest-time pairs, packing, mixing, look-alike text.

Nothing else in the library imports this subpackage.
"""
