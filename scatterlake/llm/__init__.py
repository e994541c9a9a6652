"""Operators for preparing language-model training data.

Nothing else in the package imports this subpackage, and it can be deleted
without touching the rest of the library.
"""
