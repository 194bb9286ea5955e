"""Operators for preparing large text corpora.

Nothing outside this package imports it.  Every operator takes and returns
DataFrames, works on whole texts and whole tables, and states in its docstring
what it does with nulls, empty texts, ties and repeated rows.
"""
