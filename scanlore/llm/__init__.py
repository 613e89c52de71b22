"""Operators for large training-data pipelines.

Nothing outside this package imports it; its queries are in ``queries.py``.
"""
