"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""
