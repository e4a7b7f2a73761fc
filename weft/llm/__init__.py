"""Operators of a training-data pipeline over tables of documents and pages.

Nothing outside this subpackage imports it; :mod:`weft.llm.registry` lists its
queries and the SQL they are held against.
"""
