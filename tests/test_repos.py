"""Repos: no-repeat window, replay, picks, fallback, trending parse."""

import datetime as dt

from pyspark.sql import functions as F

from broadsheet.functions.dates import previous_edition_dates
from broadsheet.operators.repos import exclude_recent, join_picks, replay_publications, repos_prompt, with_fallback
from broadsheet.sources.trending import parse_trending
from conftest import one

D = dt.date(2026, 7, 18)


def test_previous_dates_cross_month_end(spark):
    got = one(spark, previous_edition_dates(F.col("d"), 3), schema="d date", rows=[(dt.date(2024, 3, 2),)])
    assert got == [[dt.date(2024, 3, 1), dt.date(2024, 2, 29), dt.date(2024, 2, 28)]]


def test_exclude_recent_window(spark):
    """Kept out from the day after publication to the seventh; the eighth is free."""
    gaps = range(-2, 17)
    published = spark.createDataFrame([(f"r{g}", D - dt.timedelta(days=g)) for g in gaps] + [("", D), (None, D)] +
                                      [("r3", D - dt.timedelta(days=3))] * 3, "name string, edition_date date")
    trending = spark.createDataFrame([(f"r{g}", D, 5) for g in gaps] + [("new", D, 5), ("", D, 5)],
                                     "name string, edition_date date, bucket int")
    kept = exclude_recent(trending, published)
    assert kept.columns == trending.columns
    assert sorted(r["name"] for r in kept.collect()) == sorted([f"r{g}" for g in gaps if not 1 <= g <= 7] + ["new", ""])
    assert "BroadcastExchange" not in kept._jdf.queryExecution().executedPlan().toString()


def test_replay_publishes_every_eighth_day(spark):
    days = [D + dt.timedelta(days=i) for i in range(20)]
    t = spark.createDataFrame([("o/r", d) for d in days] + [("o/r", days[0])], "name string, edition_date date")
    got = sorted(r["edition_date"] for r in replay_publications(t).collect())
    assert got == [days[0], days[8], days[16]]


def test_join_picks_rules(spark):
    trending = spark.createDataFrame([
        (D, 1, "o/a", "https://github.com/o/a", "first a", "Go", 10, 1),
        (D, 2, "o/b", "https://github.com/o/b", "", "", 0, 0),
        (D, 3, "o/a", "https://github.com/o/a2", "second a", "Rust", 20, 2),
        (D, 4, "o/c", "https://github.com/o/c", "c desc", "C", 5, 0),
    ], "edition_date date, seq long, name string, url string, description string, language string, "
       "stars long, stars_today long")
    picks = spark.createDataFrame([
        (D, 1, "o/a", "  "), (D, 2, "o/missing", "x"), (D, 3, "o/b", None), (D, 4, "o/a", "Otra vez"),
        (D, 5, "o/c", "Elegido"),
    ], "edition_date date, pos long, name string, description string")
    out = join_picks(picks, trending, pick=2).orderBy("slot").collect()
    assert [(r["name"], r["url"], r["description"], r["language"], r["stars"]) for r in out] == [
        ("o/a", "https://github.com/o/a2", "second a", "Rust", 20),
        ("o/a", "https://github.com/o/a2", "Otra vez", "Rust", 20)]


def test_fallback_only_for_empty_scrape(spark):
    schema = "edition_date date, name string"
    scraped = spark.createDataFrame([(D, "s/1")], schema)
    searched = spark.createDataFrame([(D, "q/1"), (D + dt.timedelta(days=1), "q/2")], schema)
    got = sorted((r["edition_date"], r["name"]) for r in with_fallback(scraped, searched).collect())
    assert got == [(D, "s/1"), (D + dt.timedelta(days=1), "q/2")]


PAGE = """<html><article class="Box-row"><h2 class="h3"><a href="/acme/rocket">acme / rocket</a></h2>
<p class="col-9 color-fg-muted">Fast &amp;lt;small&amp;gt; <b>engine</b> &amp;amp;</p>
<span itemprop="programmingLanguage">Rust</span>
<a href="/acme/rocket/stargazers"><svg></svg> 12,345 </a><span>1,024 stars this week</span></article>
<article class="Box-row"><p>no name here</p></article>
<article class="Box-row"><h2><a href="/solo/tool">solo / tool</a></h2>
<a href="/solo/tool/stargazers"><svg></svg>87</a></article>
<article class="Box-row"><h2><a href="/third/x">x</a></h2></article></html>"""


def test_parse_trending_fields_and_limit(spark):
    pages = spark.createDataFrame([(D, PAGE)], "edition_date date, html string")
    out = parse_trending(pages, limit=2).orderBy("seq").collect()
    assert [(r["name"], r["description"], r["language"], r["stars"], r["stars_today"]) for r in out] == [
        ("acme/rocket", "Fast <small> engine &amp;", "Rust", 12345, 1024),
        ("solo/tool", "", "", 87, 0)]


def test_repos_prompt_lines(spark):
    fresh = spark.createDataFrame([(D, 1, "o/a", "Go", 1200, "Tool"), (D, 2, "o/b", "", 0, "")],
                                  "edition_date date, seq long, name string, language string, stars long, "
                                  "description string")
    p = repos_prompt(fresh, pick=5).collect()[0]["prompt"]
    assert p.endswith("1. o/a (Go · 1200★)\n   Tool\n\n2. o/b\n   (sin descripción)")
