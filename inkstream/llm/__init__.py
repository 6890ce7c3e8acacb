"""Operators for preparing language-model training text at scale.

Each module holds one operator; :mod:`inkstream.llm.queries` registers them over the supplied tables.  Nothing
outside this package imports it.
"""
