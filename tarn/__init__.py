"""Versioned lake tables for Spark: a small transactional SQL catalog beside Parquet files."""

from .api import Lake

__all__ = ["Lake"]
