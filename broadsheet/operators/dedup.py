"""J-RANK: merge duplicates by canonical URL (A1, A2) and rank by signal.

Arrival order is data: every item carries ``seq`` and "first" always means the
smallest ``seq``. All merges are declarative aggregates (min_by / max_by), so
Spark pre-aggregates them map-side: a URL that holds a third of all rows is
collapsed inside each map task before the shuffle and never lands whole in
one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.functions.text import canonical_url
from broadsheet.operators.topk import top_per_group

# Candidate cap of the default configuration and of the function
# default, and the number of top candidates that get article text.
CANDIDATE_CAP = 200
FUNCTION_DEFAULT_CAP = 120
ENRICH_TOP = 30


def _points_winner() -> Column:
    """The points of the first item holding the largest ``points ?? 0``.

    Ties keep the earlier item, and a null that ties with 0 stays null: that is
    exactly what the running "replace only when strictly larger" rule gives.
    """
    return F.max_by(F.col("points"), F.struct(F.coalesce(F.col("points"), F.lit(0)), -F.col("seq")))


def merge_items(items: DataFrame, key: Column, by: Sequence[str] = ("edition_date",),
                carry: Sequence[str] = ("title", "source", "published_at")) -> DataFrame:
    """Group items by ``by`` + ``key``: first item wins, points and snippet are inherited.

    ``snippet`` is the first non-empty one (falling back to the first item's),
    ``points`` follows ``_points_winner``; the other ``carry`` columns and
    ``seq`` come from the first item. The URL is replaced by the key; empty
    keys are skipped.
    """
    keyed = items.withColumn("_key", key)
    first = F.min_by(F.struct(*[F.col(c) for c in ("seq", *carry)]), F.col("seq")).alias("_first")
    aggs = [first, _points_winner().alias("points")]
    if "snippet" in items.columns:
        aggs += [
            F.min_by(F.col("snippet"), F.when(F.col("snippet") != "", F.col("seq"))).alias("_snip"),
            F.min_by(F.col("snippet"), F.col("seq")).alias("_snip0"),
        ]
    # the empty key is dropped after grouping: same result, and the key
    # expression is computed once instead of again in a pushed-down filter
    g = keyed.groupBy(*by, "_key").agg(*aggs).where(F.col("_key") != "")
    cols = [F.col(c) for c in by] + [F.col("_first.seq").alias("seq")]
    cols += [F.col(f"_first.{c}").alias(c) for c in carry]
    if "snippet" in items.columns:
        cols.append(F.coalesce(F.col("_snip"), F.col("_snip0")).alias("snippet"))
    cols += [F.col("_key").alias("url"), F.col("points")]
    return g.select(*cols)


def dedup_candidates(collected: DataFrame, by: Sequence[str] = ("edition_date",)) -> DataFrame:
    """A1: dedup by canonical URL inside each edition."""
    return merge_items(collected, canonical_url(F.col("url")), by=by)


def signal_order() -> list[Column]:
    """T1 order: ``points ?? 0`` desc, ``published_at`` desc (nulls last), arrival."""
    return [F.coalesce(F.col("points"), F.lit(0)).desc(), F.col("published_at").desc_nulls_last(),
            F.col("seq").asc()]


def rank_per_edition(cands: DataFrame, cap: int | Column = CANDIDATE_CAP, by: Sequence[str] = ("edition_date",),
                     most: int | None = None) -> DataFrame:
    """T1 for many editions: ``position`` 1..cap per edition.

    ``cap`` is a number or a column of ``cands`` (S5: an edition's own setting, at
    most ``most``). A huge edition is ranked in parts first, see ``top_per_group``.
    """
    return top_per_group(cands, by, signal_order(), cap, "position", ["seq"], most)


def rank_single_run(cands: DataFrame, cap: int = CANDIDATE_CAP) -> DataFrame:
    """T1 for one run: global top-``cap`` (TakeOrderedAndProject), then positions
    are numbered over those ``cap`` rows only. This is the collect-only output
    (K2) and the flagship query."""
    top = cands.orderBy(*signal_order()).limit(cap)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*signal_order())))


def enrich_targets(ranked: DataFrame, top: int | Column = ENRICH_TOP) -> DataFrame:
    """Only the first ``top`` candidates of each edition are enriched."""
    return ranked.where(F.col("position") <= top)
