"""Driver queries for J-REPOS (J5, F17, A6, trap 9, J4, W6, S7, S7b, F22, A7)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from broadsheet.operators import repos as R
from broadsheet.plans.catalog import query
from broadsheet.plans.derived import editions, repo_history, repo_picks, repos_raw
from broadsheet.plans.queries_archive import EDITIONS_SQL
from broadsheet.session import shared_folder
from broadsheet.sources.editions import read_editions, write_editions
from broadsheet.sources.tables import read_table

HISTORY_SQL = """
h AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS name, CAST(l_shipdate AS DATE) AS edition_date FROM lineitem)"""

RAW_SQL = """
raw AS (SELECT date '2024-01-01' + CAST(p_partkey % {span} AS INTEGER) AS edition_date, p_partkey AS seq,
               p_brand || '/' || p_partkey AS name, 'https://github.com/' || p_brand || '/' || p_partkey AS url,
               p_name AS description, CASE WHEN p_size % 7 = 0 THEN '' ELSE p_type END AS language,
               CAST(p_size * 100 AS BIGINT) AS stars, CAST(p_size AS BIGINT) AS stars_today, p_retailprice
        FROM part)"""


@query("repo_no_repeat", f"""
WITH {HISTORY_SQL}
SELECT t.name, t.edition_date FROM h t
WHERE NOT EXISTS (SELECT 1 FROM h p WHERE p.name = t.name
                  AND p.edition_date BETWEEN t.edition_date - INTERVAL 7 DAY AND t.edition_date - INTERVAL 1 DAY)
""")
def repo_no_repeat(spark, sf_dir):
    h = repo_history(spark, sf_dir)
    return R.exclude_recent(h, h).select("name", "edition_date")


@query("recent_names", f"""
WITH {EDITIONS_SQL},
runs AS (SELECT DISTINCT day + 3 AS edition_date FROM days),
pub AS (SELECT e.day, 'u' || e.user_id || '/r' || e.event_id AS name FROM errs e JOIN days d ON d.day = e.day
        WHERE d.n_errors > (SELECT m FROM med))
SELECT DISTINCT CAST(r.edition_date AS DATE) AS edition_date, p.name FROM runs r
JOIN pub p ON p.day BETWEEN r.edition_date - 7 AND r.edition_date - 1
""")
def recent_names(spark, sf_dir):
    """The archive written, and the names of the seven days before
    each run (three days after each edition) read back from their folders."""
    docs = editions(spark, sf_dir).withColumn("edition_date", F.to_date("date"))
    folder = shared_folder(spark, "archive")
    write_editions(docs, folder)
    archive = read_editions(spark, folder)
    runs = archive.select(F.date_add("edition_date", 3).alias("edition_date"))
    return R.recent_by_edition(archive, runs)


@query("repo_replay", f"""
WITH RECURSIVE {HISTORY_SQL},
pub(name, edition_date) AS (
  SELECT name, min(edition_date) FROM h GROUP BY name
  UNION ALL
  SELECT h.name, min(h.edition_date) FROM pub p JOIN h ON h.name = p.name
  AND h.edition_date > p.edition_date + INTERVAL 7 DAY GROUP BY h.name)
SELECT name, CAST(edition_date AS DATE) AS edition_date FROM pub
""")
def repo_replay(spark, sf_dir):
    return R.replay_publications(repo_history(spark, sf_dir))


@query("repo_picks", f"""
WITH {RAW_SQL.format(span=30)},
picks AS (SELECT date '2024-01-01' + CAST(o_orderkey % 30 AS INTEGER) AS edition_date, o_orderkey AS pos,
                 p_brand || '/' || p_partkey AS name,
                 CASE WHEN o_orderkey % 4 = 0 THEN '  ' ELSE o_orderpriority END AS p_desc
          FROM orders JOIN part ON o_custkey = p_partkey),
src AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY edition_date, name ORDER BY seq DESC) = 1),
j AS (SELECT k.edition_date, k.pos, k.name, s.url,
             trim(CASE WHEN k.p_desc IS NOT NULL AND trim(k.p_desc) <> '' THEN k.p_desc ELSE s.description END)
               AS description,
             nullif(s.language, '') AS language, nullif(s.stars, 0) AS stars
      FROM picks k JOIN src s ON s.edition_date = k.edition_date AND s.name = k.name),
f AS (SELECT * FROM j WHERE description <> '')
SELECT *, CAST(row_number() OVER (PARTITION BY edition_date ORDER BY pos) AS INTEGER) AS slot FROM f
QUALIFY slot <= 5
""")
def repo_picks_query(spark, sf_dir):
    return R.join_picks(repo_picks(spark, sf_dir), repos_raw(spark, sf_dir)) \
        .withColumn("slot", F.col("slot").cast("int"))


def _repo_answers(spark, sf_dir):
    """One answer for each order: whole, fenced, or broken in one of five ways."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    first = F.concat(F.lit('{"name":"o/'), cust, F.lit('","description":"'), F.col("o_orderpriority"), F.lit('"}'))
    entries = F.concat(first, F.lit(',{"name":'), cust, F.lit(',"description":"n"},{"name":"x/'), key,
                       F.lit('","description":5},'), first)
    whole = F.concat(F.lit('{"repos":['), entries, F.lit("]}"))
    k = F.col("o_orderkey") % 7
    raw = (F.when(k == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
           .when(k == 1, F.concat(F.lit("Elijo "), entries))
           .when(k == 2, F.lit('{"repos":"o/1"}'))
           .when(k == 3, F.lit('{"items":[]}'))
           .when(k == 4, F.concat(F.lit('{"repos":['), entries, F.lit(",null]}")))
           .when(k == 5, F.concat(F.lit("["), entries, F.lit("]"))).otherwise(whole))
    return o.select(F.lit("2024-01-01").cast("date").alias("edition_date"), F.lit(R.REPOS_CALL).alias("call_kind"),
                    key.alias("key"), F.lit(1).alias("attempt"), raw.alias("raw"))


@query("repo_answers", """
WITH a AS (SELECT *, CAST(o_orderkey AS VARCHAR) AS key FROM orders WHERE o_orderkey % 7 IN (0, 6))
SELECT key, 0 AS pos, 'o/' || o_custkey AS name, o_orderpriority AS description FROM a
UNION ALL SELECT key, 2, 'x/' || key, NULL FROM a
UNION ALL SELECT key, 3, 'o/' || o_custkey, o_orderpriority FROM a
""")
def repo_answers(spark, sf_dir):
    """Answers to picks (fences, non-string names and descriptions, repeats, broken answers)."""
    return R.answer_picks(_repo_answers(spark, sf_dir)).select("key", "pos", "name", "description")


@query("source_fallback", f"""
WITH {RAW_SQL.format(span=20)},
scraped0 AS (SELECT edition_date, name, url, description, language, stars, stars_today, 'scrape' AS origin,
                    row_number() OVER (PARTITION BY edition_date ORDER BY seq) AS rn FROM raw),
scraped AS (SELECT edition_date, name, url, description, language, stars, stars_today, origin, rn AS seq
            FROM scraped0 WHERE rn <= 25),
search_in AS (SELECT date '2024-01-01' + CAST(p_partkey % 30 AS INTEGER) AS edition_date,
                     p_brand || '/' || p_partkey AS name, 'https://github.com/' || p_brand || '/' || p_partkey AS url,
                     p_name AS description, p_type AS language, CAST(round(p_retailprice) AS BIGINT) AS stars,
                     CAST(0 AS BIGINT) AS stars_today, 'search' AS origin FROM part),
searched AS (SELECT *, row_number() OVER (PARTITION BY edition_date ORDER BY stars DESC, name) AS seq
             FROM search_in QUALIFY seq <= 25)
SELECT * FROM scraped
UNION ALL
SELECT * FROM searched s WHERE NOT EXISTS (SELECT 1 FROM scraped c WHERE c.edition_date = s.edition_date)
""")
def source_fallback(spark, sf_dir):
    cols = ["edition_date", "name", "url", "description", "language", "stars", "stars_today", "origin", "seq"]
    raw = repos_raw(spark, sf_dir, span=20)
    scraped = raw.withColumn("seq", F.row_number().over(Window.partitionBy("edition_date").orderBy("seq"))) \
        .where(F.col("seq") <= R.TRENDING_LIMIT).withColumn("origin", F.lit("scrape")).select(*cols)
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_retailprice")
    name = F.concat(F.col("p_brand"), F.lit("/"), F.col("p_partkey").cast("string"))
    search = p.select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 30).cast("int")).alias("edition_date"),
        name.alias("name"), F.concat(F.lit("https://github.com/"), name).alias("url"),
        F.col("p_name").alias("description"), F.col("p_type").alias("language"),
        F.round("p_retailprice").cast("bigint").alias("stars"), F.lit(0).cast("bigint").alias("stars_today"),
        F.lit("search").alias("origin"))
    return R.with_fallback(scraped, R.top_search(search).select(*cols)) \
        .withColumn("seq", F.col("seq").cast("bigint"))


@query("repos_prompt", f"""
WITH {HISTORY_SQL}, {RAW_SQL.format(span=30)},
shifted AS (SELECT name, DATE '2023-10-01' + CAST(date_diff('day', DATE '1992-01-01', CAST(edition_date AS DATE)) % 400 AS INTEGER)
                   AS edition_date FROM h),
page AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY edition_date ORDER BY seq) <= 25),
fresh AS (SELECT * FROM page r WHERE NOT EXISTS (SELECT 1 FROM shifted h WHERE h.name = CAST(r.seq AS VARCHAR)
                          AND h.edition_date BETWEEN r.edition_date - INTERVAL 7 DAY
                                                 AND r.edition_date - INTERVAL 1 DAY)),
top AS (SELECT *, row_number() OVER (PARTITION BY edition_date ORDER BY seq) AS i FROM fresh),
lines AS (SELECT edition_date, i,
                 i || '. ' || name ||
                 CASE WHEN concat_ws(' · ', nullif(language, ''), CASE WHEN stars <> 0 THEN stars || '★' END) <> ''
                      THEN ' (' || concat_ws(' · ', nullif(language, ''), CASE WHEN stars <> 0 THEN stars || '★' END) || ')'
                      ELSE '' END
                 || chr(10) || '   ' || CASE WHEN description <> '' THEN description ELSE '(sin descripción)' END AS line
          FROM top)
SELECT edition_date,
       'Elige los 5 repositorios más interesantes y descríbelos en castellano.' || chr(10) || chr(10)
       || 'Repositorios en tendencia hoy en GitHub:' || chr(10) || chr(10)
       || string_agg(line, chr(10) || chr(10) ORDER BY i) AS prompt
FROM lines GROUP BY edition_date
""")
def repos_prompt(spark, sf_dir):
    """The first 25 trending rows of each edition minus repos published in the
    previous 7 days, as a prompt. The history comes from ``lineitem``, keyed by part
    key, its days folded onto 400 days around the editions so that it blocks many."""
    page = repos_raw(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("edition_date").orderBy("seq"))) \
        .where(F.col("i") <= R.TRENDING_LIMIT).drop("i")
    day = F.datediff("edition_date", F.lit("1992-01-01").cast("date")) % 400
    hist = repo_history(spark, sf_dir).withColumn("edition_date", F.date_add(F.lit("2023-10-01").cast("date"), day))
    keyed = page.withColumn("label", F.col("name")).withColumn("name", F.col("seq").cast("string"))
    return R.repos_prompt(R.exclude_recent(keyed, hist).withColumn("name", F.col("label")))
