"""Operators for large text corpora, each a Spark job over a ``documents``-like table.

Nothing outside this folder imports it; ``catalog`` lists the registered queries.
"""
