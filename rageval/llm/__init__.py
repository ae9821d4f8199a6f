"""Operators for preparing training data; :mod:`.catalog` registers one query for each."""

from .catalog import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
