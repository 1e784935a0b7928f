"""Registry of driver queries: name -> Spark job and its DuckDB oracle.

Every query reads the supplied tables (or inputs Spark derives from them) in
full; outputs use the same column names and text formats as their oracle.
Timestamps leave as ISO-8601 UTC text, as the digest documents carry them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query; ``oracle`` is omitted only for non-SQL operators."""
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def iso_ts(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def load_all() -> None:
    """Import every module that registers queries."""
    from broadsheet.plans import (queries_accept, queries_archive, queries_enrich,  # noqa: F401
                                  queries_ingest, queries_rank,
                                  queries_posts, queries_repos, queries_rules, queries_scans, queries_sources)
