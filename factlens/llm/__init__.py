"""Operators of a training-data pipeline over text corpora.

Each module holds one operator with its general interface; ``queries`` binds
them to the test tables.  Nothing outside this subpackage imports it.
"""
