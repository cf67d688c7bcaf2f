"""Operators for preparing language-model training data.

Every operator takes DataFrames and returns DataFrames; ``queries.py`` applies each of them
to its whole table. Nothing outside this subpackage imports it.
"""
