"""Driver queries for J-INGEST (P1-P7, F26, A2, A3, W4) over ``events`` and ``pages``.

Each UTC day D of ``events`` is a collection run with ``as_of = D 12:00``; the
landed documents of run D hold the entries of days D-1 and D (a feed keeps
about two days of items), so every event lands in two runs by an equi-key,
never by a range join.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.operators import ingest as I
from broadsheet.operators.dedup import dedup_candidates
from broadsheet.plans.catalog import iso_ts, query
from broadsheet.plans.derived import collected, pages_in
from broadsheet.plans.queries_rank import _DEDUP_SQL
from broadsheet.plans.sqlparts import iso
from broadsheet.sources.tables import read_table

# The story queries in configuration order.
STORY_QUERIES = ["click", "error", "purchase", "signup", "view"]


def _runs(spark, sf_dir, *cols):
    ev = read_table(spark, sf_dir, "events", "ts", *cols)
    r = ev.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_d")) \
        .withColumn("run_date", F.date_add(F.to_date("ts"), F.col("_d"))).drop("_d")
    return r.withColumn("as_of", F.col("run_date").cast("timestamp") + F.expr("INTERVAL 12 HOURS"))


def feed_entries(spark, sf_dir):
    """Landed feed entries per run, with every date shape a feed may carry:
    ISO (click, signup), RFC 822 (view), unparseable (purchase), empty (error)."""
    r = _runs(spark, sf_dir, "event_id", "user_id", "event_type", "props")
    eid, et = F.col("event_id"), F.col("event_type")
    return r.select(
        "run_date", "as_of", "event_id", F.col("event_type").alias("feed"),
        F.when(eid % 17 == 0, F.lit("  ")).otherwise(F.concat(F.lit("Evento "), eid.cast("string"))).alias("title"),
        F.when(eid % 10 == 0, F.lit("")).otherwise(
            F.concat(F.lit("https://e.example/"), F.col("user_id").cast("string"), F.lit("/"), eid.cast("string")))
        .alias("link"),
        F.when(eid % 10 == 0, F.when(eid % 20 == 0, F.concat(F.lit("urn:evento:"), eid.cast("string")))
               .otherwise(F.concat(F.lit("https://e.example/g/"), eid.cast("string")))).alias("guid"),
        F.when(et.isin("click", "signup"), iso_ts("ts")).alias("isoDate"),
        F.when(et == "view", F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
        .when(et == "purchase", F.lit("not a date")).when(et == "error", F.lit("")).alias("pubDate"),
        F.col("props").alias("contentSnippet"),
        F.lit(None).cast("string").alias("content"))


FEED_SQL = f"""
r AS (SELECT e.*, CAST(ts AS DATE) + d AS run_date FROM events e, (VALUES (0), (1)) t(d)),
en AS (SELECT run_date, event_id, event_type, CAST(run_date AS TIMESTAMP) + INTERVAL 12 HOUR AS as_of,
         CASE WHEN event_id % 17 = 0 THEN '  ' ELSE 'Evento ' || event_id END AS title,
         CASE WHEN event_id % 10 = 0 THEN '' ELSE 'https://e.example/' || user_id || '/' || event_id END AS link,
         CASE WHEN event_id % 10 = 0 THEN CASE WHEN event_id % 20 = 0 THEN 'urn:evento:' || event_id
                                               ELSE 'https://e.example/g/' || event_id END END AS guid,
         CASE WHEN event_type IN ('click', 'signup') THEN {iso('ts')} END AS isoDate,
         CASE event_type WHEN 'view' THEN strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' GMT'
                         WHEN 'purchase' THEN 'not a date' WHEN 'error' THEN '' END AS pubDate,
         props FROM r),
m AS (SELECT *, trim(coalesce(nullif(link, ''), nullif(guid, ''), '')) AS url, coalesce(isoDate, pubDate, '') AS dt FROM en),
p AS (SELECT *, CASE WHEN dt = '' THEN NULL
                     WHEN regexp_matches(dt, '^[A-Za-z]+,') THEN
                          try_strptime(regexp_replace(dt, '^[A-Za-z]+,\\s*', ''), '%d %b %Y %H:%M:%S GMT')
                     ELSE try_strptime(dt, '%Y-%m-%dT%H:%M:%S.%gZ') END AS pts FROM m)"""


@query("window_filter", f"""
WITH {FEED_SQL}
SELECT run_date, event_id, trim(title) AS title, url, {iso('coalesce(pts, as_of)')} AS published_at,
       left(trim(props), 500) AS snippet
FROM p
WHERE regexp_matches(url, '^https?://') AND (pts IS NULL OR pts >= as_of - INTERVAL 24 HOUR) AND trim(title) <> ''
""")
def window_filter(spark, sf_dir):
    items = I.map_feed_items(feed_entries(spark, sf_dir))
    return items.select("run_date", "event_id", "title", "url", iso_ts("published_at").alias("published_at"),
                        "snippet")


def story_hits_input(spark, sf_dir):
    r = _runs(spark, sf_dir, "event_id", "user_id", "event_type", "value")
    return r.select(
        "run_date", "as_of", F.col("event_type").alias("query"),
        F.array_position(F.array(*[F.lit(q) for q in STORY_QUERIES]), F.col("event_type")).alias("query_ordinal"),
        F.concat(F.lit("Historia "), F.col("event_id").cast("string")).alias("title"),
        F.concat(F.lit("https://e.example/"), F.col("user_id").cast("string")).alias("url"),
        F.floor("value").cast("bigint").alias("points"),
        F.col("ts").alias("created"), F.col("event_id").alias("hit_id"))


STORY_SQL = """
h AS (SELECT CAST(ts AS DATE) + d AS run_date, event_type AS query,
                  list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS qo,
                  'Historia ' || event_id AS title, 'https://e.example/' || user_id AS url,
                  CAST(floor(value) AS BIGINT) AS points, ts AS created, event_id AS hit_id
           FROM events, (VALUES (0), (1)) t(d)),
f AS (SELECT *, CAST(run_date AS TIMESTAMP) + INTERVAL 12 HOUR AS as_of FROM h),
g AS (SELECT * FROM f WHERE created > as_of - INTERVAL 24 HOUR AND coalesce(points, 0) >= 50),
top AS (SELECT *, row_number() OVER (PARTITION BY run_date, query ORDER BY created DESC, hit_id) AS hit_pos
        FROM g QUALIFY hit_pos <= 50)"""


@query("story_top_per_query", f"""
WITH {STORY_SQL}
SELECT run_date, trim(url) AS url, first(title ORDER BY qo, hit_pos) AS title,
       {iso('first(created ORDER BY qo, hit_pos)')} AS published_at, max(coalesce(points, 0)) AS points
FROM top WHERE regexp_matches(trim(url), '^https?://') GROUP BY run_date, trim(url)
""")
def story_top_per_query(spark, sf_dir):
    merged = I.merge_story_hits(I.story_hits(story_hits_input(spark, sf_dir)))
    return merged.select("run_date", "url", "title", iso_ts("published_at").alias("published_at"), "points")


def _docs(spark, sf_dir):
    p = pages_in(spark, sf_dir).select("page_id", "url", "status", "content_type")
    return p.select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 30).cast("int")).alias("edition_date"),
        F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]+)", 1)).alias("source"),
        (F.col("status").between(200, 299) & F.col("content_type").contains("html")).alias("readable"))


_DOCS_SQL = """
d AS (SELECT date '2024-01-01' + CAST(page_id % 30 AS INTEGER) AS edition_date,
             lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#:]+)', 1)) AS source,
             page_id % 11 <> 0 AND page_id % 13 <> 0 AS readable
      FROM pages),
st AS (SELECT edition_date, source, bool_or(readable) AS ok, count(*) FILTER (WHERE readable) AS n_items
       FROM d GROUP BY edition_date, source)"""


@query("source_status", f"""
WITH {_DOCS_SQL}
SELECT * FROM st
""")
def source_status(spark, sf_dir):
    return I.source_status(_docs(spark, sf_dir))


@query("run_status", f"""
WITH {_DOCS_SQL},
{_DEDUP_SQL.format(by='edition_date,').replace('WITH', '', 1)},
nc AS (SELECT edition_date, count(*) AS n_candidates FROM merged GROUP BY edition_date),
s AS (SELECT edition_date, count(*) AS attempted, count(*) FILTER (WHERE ok) AS succeeded,
             coalesce(string_agg(CASE WHEN NOT ok THEN source END, ',' ORDER BY source), '') AS failures
      FROM st GROUP BY edition_date)
SELECT s.*, coalesce(nc.n_candidates, 0) AS n_candidates,
       CASE WHEN s.succeeded = 0 THEN 'no_source' WHEN coalesce(nc.n_candidates, 0) < 6 THEN 'too_few'
            ELSE 'ready' END AS status
FROM s LEFT JOIN nc USING (edition_date)
""")
def run_status(spark, sf_dir):
    st = I.source_status(_docs(spark, sf_dir))
    return I.run_status(st, dedup_candidates(collected(spark, sf_dir)))
