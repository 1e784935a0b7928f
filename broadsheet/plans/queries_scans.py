"""Driver queries for the landed-document scans.

The landed documents are built by Spark from the supplied tables (one RSS or
Atom document per page, one trending page per part), then parsed back; the
oracles state the expected rows directly from the same tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.operators.ingest import map_feed_items
from broadsheet.plans.catalog import iso_ts, query
from broadsheet.plans.derived import EPOCH_SECONDS, html_title
from broadsheet.plans.sqlparts import iso
from broadsheet.sources.feeds import feed_entries, parse_feed_docs
from broadsheet.sources.tables import read_table
from broadsheet.sources.trending import parse_trending


def _xml_text(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def _page_docs(spark, sf_dir, atom: bool):
    p = read_table(spark, sf_dir, "pages", "page_id", "url", "html")
    pid = F.col("page_id")
    published = F.timestamp_seconds(F.lit(EPOCH_SECONDS) + pid * 60)
    title = F.concat(F.lit("<![CDATA["), html_title(F.col("html")), F.lit("]]>"))
    url = _xml_text(F.col("url"))
    late = F.concat(url, F.lit("?via=eco"))
    if atom:
        body = F.concat(
            F.lit('<?xml version="1.0" encoding="utf-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>t</title>'),
            F.lit("<entry><title>"), title, F.lit('</title><link rel="self" href="https://self.example/x"/>'),
            F.lit('<link rel="alternate" href="'), url, F.lit('"/><id>urn:page:'), pid.cast("string"),
            F.lit("</id><published>"), iso_ts(published), F.lit("</published><summary>Resumen "),
            pid.cast("string"), F.lit("</summary></entry>"),
            F.when(pid % 5 == 0, F.concat(F.lit("<entry><title>Eco "), pid.cast("string"),
                                          F.lit('</title><link href="'), late, F.lit('"/><id>urn:eco:'),
                                          pid.cast("string"), F.lit("</id></entry>"))).otherwise(F.lit("")),
            F.when(pid % 23 == 0, F.lit("")).otherwise(F.lit("</feed>")))
    else:
        body = F.concat(
            F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>t</title><item><title>'), title,
            F.lit("</title><link>"), url, F.lit("</link><pubDate>"),
            F.date_format(published, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate><description>Resumen "),
            pid.cast("string"), F.lit("</description></item>"),
            F.when(pid % 5 == 0, F.concat(F.lit("<item><title>Eco "), pid.cast("string"),
                                          F.lit('</title><guid isPermaLink="false">'), late,
                                          F.lit("</guid></item>"))).otherwise(F.lit("")),
            F.lit("</channel>"), F.when(pid % 23 == 0, F.lit("")).otherwise(F.lit("</rss>")))
    return p.select("page_id", (published + F.expr("INTERVAL 1 HOUR")).alias("as_of"), body.alias("body"))


def _scan(spark, sf_dir, atom: bool):
    entries = feed_entries(parse_feed_docs(_page_docs(spark, sf_dir, atom)))
    items = map_feed_items(entries)
    return items.select("page_id", "item_ordinal", "title", "url", iso_ts("published_at").alias("published_at"),
                        "snippet")


_EXPECTED_FEED = f"""
WITH p AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
                  timestamp '2024-01-01' + page_id * INTERVAL 1 MINUTE AS published_at FROM pages
           WHERE page_id % 23 <> 0)
SELECT page_id, 1 AS item_ordinal, trim(title) AS title, url, {iso('published_at')} AS published_at,
       'Resumen ' || page_id AS snippet
FROM p WHERE trim(title) <> '' AND regexp_matches(url, '^https?://')
UNION ALL
SELECT page_id, 2, 'Eco ' || page_id, url || '?via=eco', {iso('published_at + INTERVAL 1 HOUR')}, ''
FROM p WHERE page_id % 5 = 0 AND regexp_matches(url, '^https?://')
"""


@query("feed_scan", _EXPECTED_FEED)
def feed_scan(spark, sf_dir):
    """S1 + P1-P4 + F26: RSS documents (CDATA titles, RFC 822 dates, guid
    fallback, a broken document every 23 pages) parsed into items."""
    return _scan(spark, sf_dir, atom=False)


@query("atom_scan", _EXPECTED_FEED)
def atom_scan(spark, sf_dir):
    """The same items as Atom entries (alternate link chosen over self)."""
    return _scan(spark, sf_dir, atom=True)


def _trending_pages(spark, sf_dir):
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    name = F.concat(F.col("p_brand"), F.lit("/"), F.col("p_partkey").cast("string"))
    block = F.concat(
        F.lit('<article class="Box-row"><h2><a href="/'), name, F.lit('">'), name,
        F.lit('</a></h2><p class="col-9 text">\n  '), F.col("p_name"),
        F.lit(" &amp;lt;b&amp;gt;</p><div>"),
        F.when(F.col("p_size") % 7 == 0, F.lit("")).otherwise(
            F.concat(F.lit('<span itemprop="programmingLanguage">'), F.col("p_type"), F.lit("</span>"))),
        F.lit('<a href="/'), name, F.lit('/stargazers"><svg></svg>\n '),
        F.format_number(F.col("p_size") * 100, 0), F.lit("\n</a>"),
        F.when(F.col("p_size") % 2 == 0, F.lit("")).otherwise(
            F.concat(F.lit('<span>'), F.col("p_size").cast("string"), F.lit(" stars today</span>"))),
        F.lit("</div></article>"))
    nameless = F.lit('<article class="Box-row"><p>sponsor</p></article>')
    html = F.concat(F.lit("<html><body>"), nameless, block, F.lit("</body></html>"))
    return p.select(F.col("p_partkey").alias("page_id"), html.alias("html"))


@query("trending_scan", """
SELECT p_partkey AS page_id, CAST(1 AS INTEGER) AS seq, p_brand || '/' || p_partkey AS name,
       'https://github.com/' || p_brand || '/' || p_partkey AS url, trim(p_name) || ' <b>' AS description,
       CASE WHEN p_size % 7 = 0 THEN '' ELSE trim(p_type) END AS language,
       CAST(p_size * 100 AS BIGINT) AS stars,
       CAST(CASE WHEN p_size % 2 = 0 THEN 0 ELSE p_size END AS BIGINT) AS stars_today
FROM part
""")
def trending_scan(spark, sf_dir):
    """S6 + F7: trending pages (a nameless block, entities encoded twice,
    thousands commas, optional language and period stars) parsed into repos."""
    return parse_trending(_trending_pages(spark, sf_dir)).withColumn("seq", F.col("seq").cast("int"))
