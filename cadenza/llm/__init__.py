"""Operators for preparing language-model training text.

Nothing outside this folder imports it. Each module holds one operator with a general interface;
``queries`` holds the thin registered queries and their SQL.
"""
