"""Driver queries for J-ENRICH."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.functions.html import extract_readable, usable_text
from broadsheet.operators import enrich as EN
from broadsheet.operators.dedup import CANDIDATE_CAP, dedup_candidates, rank_per_edition
from broadsheet.plans.catalog import query
from broadsheet.plans.derived import OTHER_READING, collected, pages_by_edition, pages_in
from broadsheet.plans.queries_rank import _DEDUP_SQL
from broadsheet.plans.sqlparts import canonical_sql

HEX = r"(?i)&#x([0-9a-f]+);"
DEC = r"&#([0-9]+);"
NAMED = r"(?i)&([a-z]+);"


def _cp(v: str) -> str:
    return f"CASE WHEN {v} IS NOT NULL AND {v} <= 1114111 AND NOT ({v} BETWEEN 55296 AND 57343) THEN chr(CAST({v} AS INTEGER)) END"


def _pass(src: str, dst: str, pat: str, dec: str) -> str:
    """One decoding pass as two CTEs: matches, then stitched pieces."""
    return f"""
{dst}m AS (SELECT *, regexp_extract_all(t, '{pat}', 0) AS m FROM {src}),
{dst} AS (SELECT * EXCLUDE (t, m),
          array_to_string(list_transform(string_split_regex(t, '{pat}'),
              lambda piece, i: piece || coalesce({dec.format(x='m[i]')}, m[i], '')), '') AS t
          FROM {dst}m)"""


_HEX_DEC = _cp("(CASE WHEN length(ltrim(regexp_extract({x}, '" + HEX + "', 1), '0')) <= 6 THEN "
               "CAST(('0x' || coalesce(nullif(ltrim(regexp_extract({x}, '" + HEX + "', 1), '0'), ''), '0')) AS BIGINT) END)")
_DEC_DEC = _cp("(CASE WHEN length(ltrim(regexp_extract({x}, '" + DEC + "', 1), '0')) <= 7 THEN "
               "CAST(coalesce(nullif(ltrim(regexp_extract({x}, '" + DEC + "', 1), '0'), ''), '0') AS BIGINT) END)")
_NAMED_DEC = ("CASE lower(regexp_extract({x}, '" + NAMED + "', 1)) WHEN 'amp' THEN '&' WHEN 'lt' THEN '<' "
              "WHEN 'gt' THEN '>' WHEN 'quot' THEN '\"' WHEN 'apos' THEN '''' WHEN 'nbsp' THEN ' ' "
              "WHEN 'mdash' THEN '—' WHEN 'ndash' THEN '–' WHEN 'hellip' THEN '…' WHEN 'rsquo' THEN '’' "
              "WHEN 'lsquo' THEN '‘' WHEN 'ldquo' THEN '“' WHEN 'rdquo' THEN '”' END")

# Readable text of every row of a relation ``src(page_id, html)``, as CTEs ending in ``readable``.
READABLE_SQL = """
paras AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<p[^>]*>([\\s\\S]*?)</p>', 1)) AS raw,
                 generate_subscripts(regexp_extract_all(html, '(?i)<p[^>]*>([\\s\\S]*?)</p>', 1), 1) AS k
          FROM {src}),
s0 AS (SELECT page_id, k, regexp_replace(raw, '<[^>]+>', ' ', 'g') AS t FROM paras),""" + \
    _pass("s0", "s1", HEX, _HEX_DEC) + "," + _pass("s1", "s2", DEC, _DEC_DEC) + "," + \
    _pass("s2", "s3", NAMED, _NAMED_DEC) + """,
s4 AS (SELECT page_id, k, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS t FROM s3),
kept AS (SELECT * FROM s4 WHERE length(t) >= 60
         QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY k) <= 8),
joined AS (SELECT page_id, trim(left(string_agg(t, ' ' ORDER BY k), 1200)) AS readable FROM kept GROUP BY page_id),
readable AS (SELECT s.page_id, coalesce(j.readable, '') AS readable FROM {src} s LEFT JOIN joined j USING (page_id))"""


@query("readable_text", f"""
WITH {READABLE_SQL.format(src='pages')}
SELECT page_id, readable, CASE WHEN length(readable) >= 80 THEN readable END AS content FROM readable
""")
def readable_text(spark, sf_dir):
    p = pages_in(spark, sf_dir).select("page_id", extract_readable(F.col("html")).alias("readable"))
    return p.select("page_id", "readable", usable_text(F.col("readable")).alias("content"))


RANKED_SQL = _DEDUP_SQL.format(by="edition_date,") + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY edition_date
                     ORDER BY coalesce(points, 0) DESC, published_at DESC, seq) AS position FROM merged),
cand AS (SELECT * FROM ranked WHERE position <= {CANDIDATE_CAP})"""


def enrich_tail(top: int) -> str:
    """Continues a WITH list that already defines ``cand``."""
    return f"""
fetched AS (SELECT page_id, url, html, CAST(date '2024-01-01' + CAST(page_id % 30 AS INTEGER) AS DATE) AS edition_date FROM pages
            WHERE page_id % 11 <> 0 AND page_id % 13 <> 0),
pin AS (SELECT page_id, edition_date, {canonical_sql('url')} AS url, html FROM (
        SELECT page_id, edition_date, url, html FROM fetched
        UNION ALL SELECT -page_id, CAST(edition_date + 1 AS DATE), url, '{OTHER_READING}' FROM fetched WHERE page_id % 4 = 1)),
pt AS (SELECT p.page_id, p.edition_date, p.url, p.html FROM pin p JOIN cand c
       ON p.edition_date = c.edition_date AND p.url = c.url AND c.position <= {top}),
{READABLE_SQL.format(src='pt')},
texts AS (SELECT pt.edition_date, pt.url,
                 first(CASE WHEN length(r.readable) >= 80 THEN r.readable END ORDER BY pt.page_id) AS content
          FROM pt JOIN readable r USING (page_id) GROUP BY pt.edition_date, pt.url),
enriched AS (SELECT c.edition_date, c.url, c.position,
                    CASE WHEN c.position <= {top} THEN t.content END AS content
             FROM cand c LEFT JOIN texts t USING (edition_date, url))"""


ENRICH_TAIL = enrich_tail(EN.ENRICH_TOP)
_ENRICH_SQL = RANKED_SQL + "," + ENRICH_TAIL


def _enriched(spark, sf_dir):
    ranked = rank_per_edition(dedup_candidates(collected(spark, sf_dir)), CANDIDATE_CAP)
    return EN.enrich(ranked, pages_by_edition(spark, sf_dir), top=EN.ENRICH_TOP)


@query("enriched_candidates", f"""
{_ENRICH_SQL}
SELECT edition_date, url, position, content FROM enriched
""")
def enriched_candidates(spark, sf_dir):
    return _enriched(spark, sf_dir).select("edition_date", "url", F.col("position").cast("bigint").alias("position"),
                                           "content")


@query("enrich_rate", f"""
{_ENRICH_SQL}
SELECT edition_date, count(*) AS n_targets, count(content) AS n_ok FROM enriched WHERE position <= {EN.ENRICH_TOP}
GROUP BY edition_date
""")
def enrich_rate(spark, sf_dir):
    return EN.enrich_rate(_enriched(spark, sf_dir), top=EN.ENRICH_TOP)
