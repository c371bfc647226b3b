"""Operators for preparing training data for language models.

Nothing outside this subpackage imports it. Each module holds one operator with a general interface;
queries.py holds the thin queries that run them over whole tables.
"""
