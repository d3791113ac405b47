"""Registry of named queries (Spark plan + DuckDB oracle SQL).

A query is a function ``(spark, sf_dir) -> DataFrame``.  Its oracle is ANSI
SQL over the raw test tables; the views it needs are prepended as CTEs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from quarry.plans.views import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def _bigint_counts(sql: str) -> str:
    """Wrap every ``count_if(...)`` in ``CAST(... AS BIGINT)`` (DuckDB returns HUGEINT; Spark returns BIGINT)."""
    out, i, token = [], 0, "count_if("
    while True:
        j = sql.find(token, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 1, j + len(token)
        while depth and k < len(sql):
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(sql[i:j])
        out.append(f"CAST(count_if({_bigint_counts(sql[j + len(token):k - 1])}) AS BIGINT)")
        i = k


def query(name: str, sql: str | None = None, views: Sequence[str] = ()):
    """Register ``fn`` under ``name``; ``sql`` (optional) is its oracle."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            text = with_views(sql, *views) if views else sql
            ORACLE[name] = _bigint_counts(text)
        return fn

    return deco


def load_all() -> None:
    # Importing the modules registers their queries.
    from quarry.plans import (  # noqa: F401
        queries_inventory,
        queries_narrative,
        queries_diagnostics,
        queries_finance,
        queries_forecast,
        queries_ingest,
        queries_quality,
        queries_series,
        queries_store,
        queries_transport,
    )
