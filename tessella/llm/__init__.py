"""Operators that prepare text for training language models.

Nothing outside this folder imports it; it uses the core's operators, functions
and tables. ``queries`` holds the pN_ queries, with those SQL twins that exist.
"""
