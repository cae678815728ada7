"""The table of registered queries; modules add to it with ``query``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .proxies import Proxy, with_

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(*proxies: str, sql: str | None = None, name: str | None = None):
    """Register a function of a :class:`Proxy`; ``sql`` is its DuckDB text after the proxies it names."""

    def add(f: Callable[[Proxy], DataFrame]):
        key = name or f.__name__
        if key in _QUERIES:
            raise ValueError(f"query {key} is registered twice")
        _QUERIES[key] = lambda spark, sf_dir: f(Proxy(spark, sf_dir))
        if sql is not None:
            _ORACLES[key] = with_(sql, *proxies) if proxies else sql
        return f

    return add


def _load() -> None:
    from . import alignment_queries, interval_queries, matching_queries, misc_queries, sequence_queries, source_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
