"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame
and returns a DataFrame; the thin queries that apply them to the registered
tables live in :mod:`ripplenet.llm.queries`.
"""
