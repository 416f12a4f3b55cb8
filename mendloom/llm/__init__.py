"""Corpus preparation for language-model training: ten operators and their queries.

Nothing outside this subpackage imports it.
"""
