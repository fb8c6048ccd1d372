"""Bindings of the operators to the parquet test tables, and their SQL twins."""
