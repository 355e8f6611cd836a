"""Operators for preparing language-model training corpora.

Each module holds one operator with a general interface; ``queries.py`` holds
the thin registered queries and their SQL.  Nothing outside this package
imports it.
"""
