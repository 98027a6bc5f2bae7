"""Operators that prepare training data for language models.

Nothing else in the library imports this subpackage; the query registry adds it when it is there.
"""
