"""Operators that prepare text, pages and vectors for training large models.

Each module holds one operator with a general interface; ``queries`` applies them to whole tables.
Nothing else in the library imports this package.
"""
