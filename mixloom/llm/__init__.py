"""Operators for training-data pipelines over the tables documents, pages, labels, conversations and benchmark.

Nothing outside this package imports it. Every operator keeps the null, tie and name-clash rules of `arrow.py`
unless its docstring says otherwise.
"""
