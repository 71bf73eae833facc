"""Operators that prepare text for training language models.

Each module holds one operator with its own general interface; ``queries`` binds them to
the synthetic tables and ``oracles`` holds the SQL that checks them.
"""
