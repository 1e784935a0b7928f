"""Driver queries for J-ARCHIVE."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.functions.dates import edition_date_local
from broadsheet.functions.text import sha8
from broadsheet.operators import archive as A
from broadsheet.plans.catalog import iso_ts, query
from broadsheet.plans.derived import editions
from broadsheet.plans.sqlparts import iso
from broadsheet.sources.tables import read_table

# Oracle form of the derived editions: per-day facts instead of nested documents.
EDITIONS_SQL = """
ev AS (SELECT event_id, ts, user_id, event_type, value, props, CAST(ts AS DATE) AS day FROM events),
top AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY value DESC, event_id) AS rank
        FROM ev QUALIFY rank <= 20),
days AS (SELECT day, max(ts) AS last_ts, count(*) FILTER (WHERE event_type = 'error') AS n_errors
         FROM ev GROUP BY day),
med AS (SELECT quantile_cont(n_errors, 0.5) AS m FROM days),
errs AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY value DESC, event_id) AS r
         FROM ev WHERE event_type = 'error' QUALIFY r <= 8),
ed AS (
  SELECT strftime(d.day, '%Y-%m-%d') AS date, d.day,
         (SELECT count(*) FROM top t WHERE t.day = d.day) AS n_items,
         (SELECT t.event_type || ' ' || t.event_id FROM top t WHERE t.day = d.day AND t.rank = 1) AS lead_title,
         CASE WHEN d.n_errors > (SELECT m FROM med)
              THEN (SELECT count(*) FROM errs e WHERE e.day = d.day) ELSE 0 END AS n_repos,
         CASE WHEN d.n_errors > (SELECT m FROM med)
              THEN (SELECT 'u' || e.user_id || '/r' || e.event_id FROM errs e WHERE e.day = d.day AND e.r = 1)
         END AS first_repo
  FROM days d)"""

WEEKDAYS_SQL = "['domingo', 'lunes', 'martes', 'miércoles', 'jueves', 'viernes', 'sábado']"
MONTHS_SQL = ("['enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', "
              "'septiembre', 'octubre', 'noviembre', 'diciembre']")


def _cap(x: str) -> str:
    return f"(upper(left({x}, 1)) || substr({x}, 2))"


def _path(d: str, prefix: str = "") -> str:
    return f"'{prefix}/' || strftime({d}, '%Y/%m/%d') || '/'"


@query("edition_index", f"""
WITH {EDITIONS_SQL}
SELECT date,
       CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS numero,
       {_path('day')} AS path,
       lead({_path('day')}) OVER (ORDER BY date) AS newer_path,
       lag({_path('day')}) OVER (ORDER BY date) AS older_path,
       CAST(n_items AS INTEGER) AS n_items, CAST(n_repos AS INTEGER) AS n_repos, lead_title,
       {_cap(f'{WEEKDAYS_SQL}[dayofweek(day) + 1]')} || ', ' || day(day) || ' de '
         || {MONTHS_SQL}[month(day)] || ' de ' || year(day) AS long_date,
       day(day) || ' ' || left({MONTHS_SQL}[month(day)], 3) AS short_date
FROM ed
""")
def edition_index(spark, sf_dir):
    return A.edition_index(editions(spark, sf_dir)).select(
        "date", F.col("numero").cast("int").alias("numero"), "path", "newer_path", "older_path",
        "n_items", "n_repos", "lead_title", "long_date", "short_date")


@query("repos_edition_index", f"""
WITH {EDITIONS_SQL},
r AS (SELECT * FROM ed WHERE n_repos > 0)
SELECT date, {_path('day', '/repositorios')} AS repos_path,
       lead({_path('day', '/repositorios')}) OVER (ORDER BY date) AS repos_newer_path,
       lag({_path('day', '/repositorios')}) OVER (ORDER BY date) AS repos_older_path,
       CAST(n_repos AS INTEGER) AS n_repos, first_repo
FROM r
""")
def repos_edition_index(spark, sf_dir):
    return A.repos_edition_index(editions(spark, sf_dir)).select(
        "date", "repos_path", "repos_newer_path", "repos_older_path", "n_repos",
        F.col("repos")[0]["name"].alias("first_repo"))


@query("archive_by_month", f"""
WITH {EDITIONS_SQL}
SELECT strftime(day, '%Y-%m') AS month_key,
       {_cap(f'{MONTHS_SQL}[month(min(day))]')} || ' de ' || year(min(day)) AS month_title,
       CAST(count(*) AS INTEGER) AS n_editions,
       string_agg(date, ',' ORDER BY date DESC) AS dates_desc,
       sum(n_items) AS n_items_total,
       min(date) AS first_date, max(date) AS last_date
FROM ed GROUP BY strftime(day, '%Y-%m')
""")
def archive_by_month(spark, sf_dir):
    return A.by_month(editions(spark, sf_dir))


@query("latest_edition", f"""
WITH {EDITIONS_SQL}
SELECT date, CAST(n_items AS INTEGER) AS n_items, lead_title FROM ed ORDER BY date DESC LIMIT 1
""")
def latest_edition(spark, sf_dir):
    return A.latest_edition(editions(spark, sf_dir)).select("date", "n_items", "lead_title")


@query("calendar_grid", f"""
WITH {EDITIONS_SQL},
span AS (SELECT min(day) AS lo, max(day) AS hi FROM ed),
cal AS (SELECT CAST(g AS DATE) AS d, strftime(lo, '%Y-%m') AS min_ym, strftime(hi, '%Y-%m') AS max_ym, hi
        FROM span, generate_series(CAST(date_trunc('month', lo) AS TIMESTAMP), CAST(last_day(hi) AS TIMESTAMP),
                                   INTERVAL 1 DAY) AS s(g))
SELECT c.d AS date, strftime(c.d, '%Y-%m') AS month_key, CAST(day(c.d) AS INTEGER) AS day,
       CAST((dayofweek(date_trunc('month', c.d)) + 6) % 7 AS INTEGER) AS offset,
       CAST(day(last_day(c.d)) AS INTEGER) AS days_in_month,
       e.day IS NOT NULL AS available,
       CASE WHEN e.day IS NOT NULL THEN {_path('e.day')} END AS url,
       c.d = c.hi AS is_current,
       strftime(c.d, '%Y-%m') > c.min_ym AS prev_enabled,
       strftime(c.d, '%Y-%m') < c.max_ym AS next_enabled
FROM cal c LEFT JOIN ed e ON e.day = c.d
""")
def calendar_grid(spark, sf_dir):
    return A.calendar_grid(editions(spark, sf_dir))


@query("edition_dates_local", f"""
WITH l AS (SELECT CAST(timezone('Europe/Madrid', timezone('UTC', CAST(ts AS TIMESTAMP))) AS DATE) AS edition_date, ts
           FROM events)
SELECT edition_date, count(*) AS n_events, {iso('min(ts)')} AS first_ts, {iso('max(ts)')} AS last_ts
FROM l GROUP BY edition_date
""")
def edition_dates_local(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", "ts")
    return ev.groupBy(edition_date_local(F.col("ts")).alias("edition_date")).agg(
        F.count("*").alias("n_events"), iso_ts(F.min("ts")).alias("first_ts"), iso_ts(F.max("ts")).alias("last_ts"))


@query("text_fingerprint", """
SELECT doc_id, coalesce(left(sha256(text), 8), '0') AS fingerprint FROM documents
""")
def text_fingerprint(spark, sf_dir):
    return read_table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", sha8("text").alias("fingerprint"))


@query("pending_editions", f"""
WITH {EDITIONS_SQL},
runs AS (SELECT CAST(timezone('Europe/Madrid', timezone('UTC', CAST(ts AS TIMESTAMP))) AS DATE) AS edition_date,
                max(ts) AS as_of
         FROM events GROUP BY 1)
SELECT edition_date, {iso('as_of')} AS as_of FROM runs
WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.day = runs.edition_date)
""")
def pending_editions(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", "ts")
    runs = ev.groupBy(edition_date_local(F.col("ts")).alias("edition_date")).agg(F.max("ts").alias("as_of"))
    return A.pending_editions(runs, editions(spark, sf_dir)).select("edition_date", iso_ts("as_of").alias("as_of"))
