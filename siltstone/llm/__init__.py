"""Operators that prepare large text corpora for model training.

Nothing outside this subpackage imports it.  ``queries`` holds the thin
registered queries; every operator keeps a general interface of its own.
"""
