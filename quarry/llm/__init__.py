"""Operators for large training-data corpora.

Nothing outside this package imports it; each module holds one operator and the
query that the entry file registers for it.
"""
