"""Registered queries over the tables of a data folder, and the same in DuckDB SQL."""

from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
