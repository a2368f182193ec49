"""Operators of a training-data pipeline over text documents, vectors and conversations.

Each module holds one operator with a general interface; ``queries`` holds the
thin registered queries. Nothing outside this package imports it.
"""
