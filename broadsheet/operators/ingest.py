"""J-INGEST: landed feed entries and story hits become news items
(P1-P7, F26, A2, A3, W4, U1).

"Now" is a column: every row carries the ``as_of`` of its run, so one job
filters many runs at once with ordinary predicates that Catalyst pushes down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.dates import parse_feed_date
from broadsheet.functions.text import js_trim
from broadsheet.operators.topk import top_per_group

# ---------------------------------------------------------------------------
# Fixed values of the default configuration.
WINDOW_HOURS = 24
STORY_MIN_POINTS = 50
HITS_PER_QUERY = 50
SNIPPET_CHARS = 500
STORY_SOURCE = "Hacker News"
MIN_CANDIDATES = 6
WEB_URL = r"^https?://"
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def window_start(as_of, hours: int | Column = WINDOW_HOURS) -> Column:
    return _c(as_of) - F.make_dt_interval(F.lit(0), F.lit(hours) if isinstance(hours, int) else hours)


def map_feed_items(entries: DataFrame, hours: int | Column = WINDOW_HOURS) -> DataFrame:
    """P1-P4 on parsed feed entries: P2 URL rule, P3 window, P4 snippet. ``hours`` is a
    number or a column of ``entries``.

    ``entries`` has ``title, link, guid, isoDate, pubDate, contentSnippet,
    content`` (strings) plus ``as_of`` and any carried columns. Drops, in order:
    URL that is not http(s) (``link`` or, when empty, ``guid``), a date that
    parses and is older than the window (undated and future rows stay), blank
    title. Undated rows get ``published_at = as_of``.
    """
    url = js_trim(F.coalesce(F.nullif(F.col("link"), F.lit("")), F.nullif(F.col("guid"), F.lit("")), F.lit("")))
    date_text = F.coalesce(F.col("isoDate"), F.col("pubDate"), F.lit(""))
    ts = F.when(date_text != "", parse_feed_date(date_text))
    title = js_trim(F.coalesce(F.col("title"), F.lit("")))
    snippet = F.substring(js_trim(F.coalesce(F.col("contentSnippet"), F.col("content"), F.lit(""))), 1, SNIPPET_CHARS)
    carried = [c for c in entries.columns if c not in
               ("title", "link", "guid", "isoDate", "pubDate", "contentSnippet", "content")]
    return (entries.select(*carried, url.alias("url"), ts.alias("_ts"), title.alias("title"), snippet.alias("snippet"))
            .where(F.col("url").rlike(WEB_URL))
            .where(F.col("_ts").isNull() | (F.col("_ts") >= window_start(F.col("as_of"), hours)))
            .where(F.col("title") != "")
            .withColumn("published_at", F.coalesce(F.col("_ts"), F.col("as_of")))
            .drop("_ts"))


def story_hits(hits: DataFrame, hours: int | Column = WINDOW_HOURS, min_points: int | Column = STORY_MIN_POINTS,
               per_query: int = HITS_PER_QUERY, by: tuple[str, ...] = ("run_date",)) -> DataFrame:
    """P5 + W4: hits newer than the window (strict) with enough points, newest
    ``per_query`` per query; then external http(s) URLs only.

    ``hits`` has ``query, query_ordinal, title, url, points, created`` and
    ``as_of``; ``hours`` and ``min_points`` may be columns of it. A query with very
    many hits is ranked in parts first, see ``top_per_group``.
    The API applies the filters before its page limit, hence filter first.
    """
    f = hits.where((F.col("created") > window_start(F.col("as_of"), hours))
                   & (F.coalesce(F.col("points"), F.lit(0)) >= min_points))
    top = top_per_group(f, [*by, "query"], [F.col("created").desc(), F.col("hit_id")], per_query, "hit_pos", ["hit_id", "url"])
    return top.withColumn("url", js_trim(F.coalesce(F.col("url"), F.lit("")))).where(F.col("url").rlike(WEB_URL))


def merge_story_hits(top: DataFrame, by: tuple[str, ...] = ("run_date",)) -> DataFrame:
    """A2 + P6: one item per raw URL across queries; first title and date win
    (query order, then newest first); points = largest ``points ?? 0``.

    All merges are partial aggregates, so a URL hit by every query is combined
    map-side.
    """
    order = F.struct(F.col("query_ordinal"), F.col("hit_pos"))
    g = top.groupBy(*by, "url").agg(
        F.min_by(F.struct(js_trim(F.coalesce(F.col("title"), F.lit(""))).alias("title"),
                          F.col("created").alias("published_at")), order).alias("first"),
        F.max(F.coalesce(F.col("points"), F.lit(0))).alias("points"),
        F.min(order).alias("arrival"))
    return g.select(*by, "url", F.col("first.title").alias("title"), F.lit("").alias("snippet"),
                    F.lit(STORY_SOURCE).alias("source"), F.col("first.published_at").alias("published_at"),
                    F.col("points").cast("bigint").alias("points"), "arrival")


def source_status(docs: DataFrame, by: tuple[str, ...] = ("edition_date",)) -> DataFrame:
    """A3 per source: a source succeeds when any of its documents was read;
    ``n_items`` counts items from readable documents; ``fragile`` is carried if
    the documents have it."""
    fragile = [F.bool_or("fragile").alias("fragile")] if "fragile" in docs.columns else []
    return docs.groupBy(*by, "source").agg(
        F.bool_or("readable").alias("ok"),
        F.count_if(F.col("readable")).alias("n_items"), *fragile)


def run_status(status: DataFrame, candidates: DataFrame, by: str = "edition_date") -> DataFrame:
    """A3 totals + P7 gates per run: attempted, succeeded, failed sources (in
    name order), candidates after dedup, and the run status. The list of failures
    holds a run's configured sources at most; ``source_failures`` has them as rows."""
    s = status.groupBy(by).agg(
        F.count("*").alias("attempted"),
        F.count_if("ok").alias("succeeded"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("source")))), ",").alias("failures"))
    n = candidates.groupBy(by).agg(F.count("*").alias("n_candidates"))
    j = s.join(n, by, "left").withColumn("n_candidates", F.coalesce(F.col("n_candidates"), F.lit(0)))
    return j.withColumn("status", F.when(F.col("succeeded") == 0, F.lit("no_source"))
                        .when(F.col("n_candidates") < MIN_CANDIDATES, F.lit("too_few"))
                        .otherwise(F.lit("ready")))


def source_failures(status: DataFrame, by: str = "edition_date") -> DataFrame:
    """A3: one row for each failed source of a run with its ``reason``, and ``level``:
    ``ignored`` for fragile sources, else ``warning``."""
    return status.where(~F.col("ok")).select(
        by, "source", "reason", F.when(F.coalesce("fragile", F.lit(False)), "ignored").otherwise("warning").alias("level"))


def idle_runs(runs: DataFrame, published: DataFrame | None = None, by: str = "edition_date") -> DataFrame:
    """Runs that do nothing, with their status: ``published`` (the edition is
    there already), else ``skipped`` (``runs`` has a column ``has_credential`` and
    it is not true)."""
    known = runs.select(by, (F.coalesce("has_credential", F.lit(False)) if "has_credential" in runs.columns else F.lit(True)).alias("__may"))
    if published is not None:
        known = known.join(published.select(by, F.lit(True).alias("__done")).distinct(), by, "left")
    else:
        known = known.withColumn("__done", F.lit(None).cast("boolean"))
    status = F.when(F.col("__done"), "published").when(~F.col("__may"), "skipped")
    return known.select(by, status.alias("status")).where("status is not null")
