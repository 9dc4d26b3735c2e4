"""Operators for building training data from a document corpus.

Nothing outside this subpackage imports it.
"""
