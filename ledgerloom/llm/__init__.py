"""Preparation of training data: linkage, fusion, name variants, token encoding, leak search, language labels.

Nothing else in the library imports this subpackage.
"""
