"""Readers: the parquet test tables plus the reference's file formats."""
from factlens.sources.tables import TABLES, table

__all__ = ["TABLES", "table"]
