"""Operators that prepare text for language-model training.

Nothing outside this package imports it; deleting it leaves the search engine whole.
"""
