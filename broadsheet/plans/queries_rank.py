"""Driver queries for J-RANK: canonical URLs, dedup, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.functions.text import canonical_url
from broadsheet.operators.dedup import (CANDIDATE_CAP, dedup_candidates, merge_items,
                                        rank_per_edition, rank_single_run)
from broadsheet.plans.catalog import iso_ts, query
from broadsheet.plans.derived import collected, edition_config
from broadsheet.sources.config import edition_settings, largest
from broadsheet.sources.feeds import configured_docs
from broadsheet.plans.sqlparts import COLLECTED, canonical_sql, iso
from broadsheet.sources.tables import read_table

CAND_COLS = ["edition_date", "seq", "title", "snippet", "url", "source", "published_at", "points"]


def _out(df, *extra):
    cols = [c for c in CAND_COLS if c in df.columns] + list(extra)
    return df.select(*[iso_ts(c).alias(c) if c == "published_at"
                       else F.col(c).cast("bigint").alias(c) if c == "position" else F.col(c) for c in cols])


@query("canonical_urls", f"""
SELECT page_id, url, {canonical_sql('url')} AS canonical_url FROM pages
""")
def canonical_urls(spark, sf_dir):
    return read_table(spark, sf_dir, "pages", "page_id", "url").select(
        "page_id", "url", canonical_url(F.col("url")).alias("canonical_url"))


_DEDUP_SQL = f"""
WITH {COLLECTED},
keyed AS (SELECT *, {canonical_sql('url')} AS k FROM collected),
merged AS (
  SELECT {{by}} k AS url,
         min(seq) AS seq,
         first(title ORDER BY seq) AS title,
         coalesce(first(snippet ORDER BY seq) FILTER (WHERE snippet <> ''), first(snippet ORDER BY seq)) AS snippet,
         first(source ORDER BY seq) AS source,
         first(published_at ORDER BY seq) AS published_at,
         first(points ORDER BY coalesce(points, 0) DESC, seq) AS points
  FROM keyed WHERE k <> ''
  GROUP BY {{by}} k
)"""


@query("candidates_dedup", _DEDUP_SQL.format(by="edition_date,") + f"""
SELECT edition_date, seq, title, snippet, url, source, {iso('published_at')} AS published_at, points FROM merged
""")
def candidates_dedup(spark, sf_dir):
    return _out(dedup_candidates(collected(spark, sf_dir)))


@query("candidates_ranked", _DEDUP_SQL.format(by="") + f"""
SELECT seq, title, snippet, url, source, {iso('published_at')} AS published_at, points,
       row_number() OVER (ORDER BY coalesce(points, 0) DESC, published_at DESC, seq) AS position
FROM merged
ORDER BY position
LIMIT {CANDIDATE_CAP}
""")
def candidates_ranked(spark, sf_dir):
    """Flagship (collect-only run): everything collected is one run; dedup, rank, cap."""
    merged = merge_items(collected(spark, sf_dir), canonical_url(F.col("url")), by=())
    return _out(rank_single_run(merged, CANDIDATE_CAP), "position")


@query("candidates_per_edition", _DEDUP_SQL.format(by="edition_date,") + f""",
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY edition_date
                               ORDER BY coalesce(points, 0) DESC, published_at DESC, seq) AS position
  FROM merged)
SELECT edition_date, seq, title, snippet, url, source, {iso('published_at')} AS published_at, points, position
FROM ranked WHERE position <= {CANDIDATE_CAP}
""")
def candidates_per_edition(spark, sf_dir):
    """Top candidates of every edition at once (row_number per edition)."""
    return _out(rank_per_edition(dedup_candidates(collected(spark, sf_dir)), cap=CANDIDATE_CAP), "position")


@query("configured_candidates", _DEDUP_SQL.format(by="edition_date,").replace(
    "FROM collected)", "FROM collected WHERE length(source) % 3 <> 0)", 1) + f""",
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY edition_date
                               ORDER BY coalesce(points, 0) DESC, published_at DESC, seq) AS position
  FROM merged)
SELECT edition_date, seq, title, snippet, url, source, {iso('published_at')} AS published_at, points, position
FROM ranked WHERE position <= 3 + datediff('day', date '2024-01-01', edition_date) % 7 * 5
""")
def configured_candidates(spark, sf_dir):
    """S5 + T1: every edition with its own configuration: disabled sources leave, and
    the cap of the ranking is a column."""
    items = collected(spark, sf_dir)
    config = edition_config(items)
    settings = edition_settings(config, config)
    merged = dedup_candidates(configured_docs(items, config))
    ranked = rank_per_edition(merged.join(settings.select("edition_date", "candidate_cap"), "edition_date"),
                              F.col("candidate_cap"), most=largest(settings)["candidate_cap"])
    return _out(ranked, "position")
