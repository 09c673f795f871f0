"""Operators of a training-data pipeline over document, embedding, page and conversation tables.

Nothing outside this subpackage imports it.
"""
