"""Feed scans, window filter and date parsing."""

import datetime as dt

from pyspark.sql import functions as F

from broadsheet.functions.dates import parse_feed_date
from broadsheet.operators.ingest import map_feed_items
from broadsheet.sources.feeds import enabled_sources, feed_entries, parse_feed_docs
from conftest import one

RSS = """<?xml version="1.0" encoding="UTF-8"?>
<rss version="2.0"><channel><title>Lab notes</title>
<item><title><![CDATA[Model card v2 & notes]]></title><link>https://lab.example/posts/a</link>
  <pubDate>Fri, 17 Jul 2026 20:00:00 GMT</pubDate><description>&lt;p&gt;Short &amp;amp; sweet&lt;/p&gt;</description></item>
<item><title>From guid</title><guid isPermaLink="true">https://lab.example/posts/b</guid>
  <pubDate>Fri, 17 Jul 2026 21:30:00 +0000</pubDate></item>
<item><title>Too old</title><link>https://lab.example/posts/c</link><pubDate>Mon, 01 Jun 2026 00:00:00 GMT</pubDate></item>
<item><title>Undated</title><link>https://lab.example/posts/d</link></item>
<item><title>Not a web link</title><guid isPermaLink="false">tag:lab,2026:e</guid></item>
</channel></rss>"""

ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>Atom lab</title>
<entry><title>Atom one</title><link rel="self" href="https://atom.example/self/1"/>
  <link rel="alternate" href="https://atom.example/1"/><id>urn:1</id><updated>2026-07-17T19:00:00Z</updated>
  <summary>Plain summary</summary></entry>
</feed>"""


def test_parse_feed_date_shapes(spark):
    rows = [("Fri, 17 Jul 2026 20:00:00 GMT",), ("Mon, 01 Jul 2026 10:00:00 +0200",),
            ("2026-07-17T20:00:00Z",), ("17 Jul 26 20:00 GMT",), ("garbage",), ("",)]
    got = one(spark, parse_feed_date(F.col("x")), rows=rows)
    assert got[0] == dt.datetime(2026, 7, 17, 20, 0)
    assert got[1] == dt.datetime(2026, 7, 1, 8, 0)  # wrong weekday accepted, offset applied
    assert got[2] == dt.datetime(2026, 7, 17, 20, 0)
    assert got[3] == dt.datetime(2026, 7, 17, 20, 0)
    assert got[4] is None and got[5] is None
    more = one(spark, parse_feed_date(F.col("x")), rows=[("17 Jul 2026 20:00 +0100",), ("Fri, 17 Jul 26 20:00:30 -0130",)])
    assert more == [dt.datetime(2026, 7, 17, 19, 0), dt.datetime(2026, 7, 17, 21, 30, 30)]


def test_rss_scan_window_and_fallbacks(spark):
    as_of = dt.datetime(2026, 7, 17, 22, 0)
    docs = spark.createDataFrame([("lab", as_of, RSS), ("broken", as_of, "<rss><channel><item>")],
                                 "source string, as_of timestamp, body string")
    parsed = parse_feed_docs(docs)
    assert {r["source"]: r["parsed"] for r in parsed.collect()} == {"lab": True, "broken": False}
    items = map_feed_items(feed_entries(parsed)).orderBy("item_ordinal").collect()
    assert [r["title"] for r in items] == ["Model card v2 & notes", "From guid", "Undated"]
    assert items[1]["url"] == "https://lab.example/posts/b"
    assert items[2]["published_at"] == as_of
    assert items[0]["snippet"] == "Short & sweet"


def test_window_edge_is_kept(spark):
    as_of = dt.datetime(2026, 7, 18, 0, 0)
    rows = [("edge", "https://e.example/1", None, "Fri, 17 Jul 2026 00:00:00 GMT", as_of),
            ("before", "https://e.example/2", None, "Thu, 16 Jul 2026 23:59:59 GMT", as_of),
            ("future", "https://e.example/3", None, "Sun, 19 Jul 2026 00:00:00 GMT", as_of)]
    df = spark.createDataFrame(rows, "title string, link string, guid string, pubDate string, as_of timestamp") \
        .withColumn("isoDate", F.lit(None).cast("string")).withColumn("contentSnippet", F.lit(None).cast("string")) \
        .withColumn("content", F.lit(None).cast("string"))
    kept = sorted(r["title"] for r in map_feed_items(df).collect())
    assert kept == ["edge", "future"]


def test_atom_alternate_link(spark):
    docs = spark.createDataFrame([("atom", dt.datetime(2026, 7, 17, 22, 0), ATOM)],
                                 "source string, as_of timestamp, body string")
    e = feed_entries(parse_feed_docs(docs)).collect()
    assert e[0]["link"] == "https://atom.example/1" and e[0]["isoDate"] == "2026-07-17T19:00:00Z"


def test_enabled_sources_keep_config_order(spark):
    cfg = spark.createDataFrame(
        [([("a", "A", "https://a.example/feed", True, False), ("b", "B", "https://b.example/feed", False, False),
           ("c", "C", "https://c.example/atom", True, True)],)],
        "rss array<struct<id string, name string, url string, enabled boolean, fragile boolean>>")
    got = [(r["source_ordinal"], r["source"], r["fragile"]) for r in enabled_sources(cfg).collect()]
    assert got == [(0, "A", False), (2, "C", True)]


def test_config_reader(spark, tmp_path):
    import json

    from broadsheet.sources.config import enabled_sources, job_parameters, read_config, story_queries
    cfg = {"user_agent": "ua", "timeout_ms": 5000, "window_hours": 12, "candidate_cap": 50, "enrich_top": 10,
           "enrich_timeout_ms": 4000,
           "rss": [{"id": "a", "name": "Feed A", "url": "https://a.example/rss", "enabled": True, "fragile": False},
                   {"id": "b", "name": "Feed B", "url": "https://b.example/rss", "enabled": False, "fragile": False},
                   {"id": "c", "name": "Feed C", "url": "https://c.example/atom", "enabled": True, "fragile": True}],
           "hackernews": {"id": "s", "name": "Stories", "enabled": True, "min_points": 30, "queries": ["x", "y"]},
           "huggingface_trending": {"id": "m", "name": "Models", "enabled": False, "limit": 5},
           "github_trending": {"id": "g", "name": "Repos", "enabled": True, "since": "weekly", "limit": 9, "pick": 3}}
    path = tmp_path / "sources.json"
    path.write_text(json.dumps(cfg, indent=2))
    conf = read_config(spark, str(path))
    feeds = [(r["source_ordinal"], r["source"], r["fragile"]) for r in enabled_sources(conf).orderBy("source_ordinal").collect()]
    assert feeds == [(0, "Feed A", False), (2, "Feed C", True)]
    assert [(r["query_ordinal"], r["query"]) for r in story_queries(conf).orderBy("query_ordinal").collect()] == [
        (1, "x"), (2, "y")]
    p = job_parameters(conf)
    assert (p["window_hours"], p["candidate_cap"], p["min_points"], p["models_enabled"], p["pick"]) == (12, 50, 30, False, 3)
