"""Operators for preparing training corpora.

Every operator takes and returns DataFrames; nothing outside this package
imports it.  ``queries.py`` has the thin registered queries.
"""
