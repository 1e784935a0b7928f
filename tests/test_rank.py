"""Canonical URLs, dedup by URL and signal ranking."""

import datetime as dt

from pyspark.sql import functions as F

from broadsheet.functions.text import canonical_url, js_trim
from broadsheet.operators.dedup import merge_items, rank_per_edition, rank_single_run
from conftest import one


def test_canonical_url_rules(spark):
    cases = {
        "https://Ex.COM/news/1#section": "https://ex.com/news/1",
        "https://ex.com/a?utm_source=x&UTM_Medium=y&id=7": "https://ex.com/a?id=7",
        "https://ex.com/a?ref=home&fbclid=abc": "https://ex.com/a",
        "https://ex.com/a/": "https://ex.com/a",
        "https://ex.com/a/?id=3": "https://ex.com/a/?id=3",
        "https://ex.com": "https://ex.com",
        "https://ex.com?x=1": "https://ex.com/?x=1",
        "http://ex.com:80/p": "http://ex.com/p",
        "https://ex.com:8443/p": "https://ex.com:8443/p",
        "  https://ex.com/p  ": "https://ex.com/p",
        "not a url": "not a url",
        "https://ex.com/q?a=1&utm_x=2&flag": "https://ex.com/q?a=1&flag=",
        "https://ex.com/q?name=a%20b&ref=z": "https://ex.com/q?name=a+b",
        "https://ex.com/q?Ref=keep": "https://ex.com/q?Ref=keep",
    }
    got = one(spark, canonical_url(F.col("x")), rows=[(k,) for k in cases])
    assert got == list(cases.values())


def test_js_trim_unicode_spaces(spark):
    got = one(spark, js_trim(F.col("x")), rows=[("\u00a0\ufeff x y \u2003\n",)])
    assert got == ["x y"]


def _items(spark, rows):
    schema = "edition_date date, seq long, title string, snippet string, url string, source string, " \
             "published_at timestamp, points long"
    return spark.createDataFrame(rows, schema)


D = dt.date(2026, 7, 18)
T0 = dt.datetime(2026, 7, 18, 8, 0, 0)


def test_dedup_first_wins_points_and_snippet_inherited(spark):
    rows = [
        (D, 1, "First", "", "https://a.example/x?utm_source=feed", "Feed", T0, None),
        (D, 2, "Second", "text", "https://a.example/x/", "HN", T0, 0),
        (D, 3, "Third", "other", "https://a.example/x#c", "HN", T0, 42),
        (D, 4, "Fourth", "", "https://a.example/x", "HN", T0, 42),
        (D, 5, "Lone", "", "https://b.example/y", "Feed", T0, None),
        (D, 6, "Zero", "", "https://c.example/z", "Feed", T0, 0),
        (D, 7, "ZeroNull", "", "https://c.example/z", "Feed", T0, None),
    ]
    out = {r["url"]: r for r in merge_items(_items(spark, rows), canonical_url(F.col("url"))).collect()}
    a = out["https://a.example/x"]
    assert (a["title"], a["source"], a["seq"], a["snippet"], a["points"]) == ("First", "Feed", 1, "text", 42)
    assert out["https://b.example/y"]["points"] is None
    # null does not replace 0 and 0 does not replace null
    assert out["https://c.example/z"]["points"] == 0


def test_null_points_stay_null_against_zero(spark):
    rows = [(D, 1, "A", "", "https://a.example/1", "S", T0, None),
            (D, 2, "B", "", "https://a.example/1", "S", T0, 0)]
    out = merge_items(_items(spark, rows), canonical_url(F.col("url"))).collect()
    assert out[0]["points"] is None


def test_signal_order_and_cap(spark):
    rows = [
        (D, 1, "old", "", "https://a.example/1", "S", T0 - dt.timedelta(hours=3), None),
        (D, 2, "new", "", "https://a.example/2", "S", T0, None),
        (D, 3, "hot", "", "https://a.example/3", "S", T0 - dt.timedelta(hours=9), 300),
        (D, 4, "warm", "", "https://a.example/4", "S", T0 - dt.timedelta(hours=9), 12),
        (D, 5, "tie", "", "https://a.example/5", "S", T0, None),
    ]
    ranked = rank_per_edition(_items(spark, rows), cap=4).orderBy("position").collect()
    assert [r["title"] for r in ranked] == ["hot", "warm", "new", "tie"]
    single = rank_single_run(_items(spark, rows), cap=2).orderBy("position").collect()
    assert [(r["title"], r["position"]) for r in single] == [("hot", 1), ("warm", 2)]


DOT_CASES = {
    "https://x.example/a/./b/../c": "https://x.example/a/c",
    "https://x.example/a/b/..": "https://x.example/a",
    "https://x.example/a/b/../?id=1": "https://x.example/a/?id=1",
    "https://x.example/%2E%2e/x": "https://x.example/x",
    "https://x.example/a\\b": "https://x.example/a/b",
    "https://x.example/.well-known/x": "https://x.example/.well-known/x",
    "https://x.example/..": "https://x.example",
    "https://x.example/a/%2e/b?utm_source=z": "https://x.example/a/b",
}


ENCODE_CASES = {
    "https://x.example/año/ñ?q=é": "https://x.example/a%C3%B1o/%C3%B1?q=%C3%A9",
    "https://x.example/a b": "https://x.example/a%20b",
    "https://x.example/a%C3%B1o": "https://x.example/a%C3%B1o",
    "https://x.example/a?q=it's": "https://x.example/a?q=it%27s",
    "https://x.example/p?utm_source=1&q=a b": "https://x.example/p?q=a+b",
    "https://x.example/x/../y/{z}": "https://x.example/y/%7Bz%7D",
    "https://x.example:0443/a\tb\n": "https://x.example/ab",
    "http://x.example:08080/p": "http://x.example:8080/p",
    "http://x.example:70000/p": "http://x.example:70000/p",
    "not\ta url": "not\ta url",
}


def test_canonical_url_percent_encoding(spark):
    got = one(spark, canonical_url(F.col("x")), rows=[(k,) for k in ENCODE_CASES])
    assert got == list(ENCODE_CASES.values())


def test_canonical_url_dot_segments(spark):
    got = one(spark, canonical_url(F.col("x")), rows=[(k,) for k in DOT_CASES])
    assert got == list(DOT_CASES.values())


def test_canonical_oracle_agrees_on_tricky_urls(spark):
    import duckdb

    from broadsheet.plans.sqlparts import canonical_sql
    urls = list(DOT_CASES) + list(ENCODE_CASES) + ["https://Ex.COM:443/a/?utm_x=1&b=%20c#f", "ftp://x/y", "  https://x.example  "]
    con = duckdb.connect()
    con.execute("CREATE TABLE u AS SELECT unnest(?::VARCHAR[]) AS url", [urls])
    want = dict(con.execute(f"SELECT url, {canonical_sql('url')} FROM u").fetchall())
    got = one(spark, canonical_url(F.col("x")), rows=[(u,) for u in urls])
    assert got == [want[u] for u in urls]


def test_canonical_url_user_info_backslash_and_mixed_escapes(spark):
    cases = {
        "https://User:Pass@Host.com/a": "https://User:Pass@host.com/a",
        "https://User:@Host.com/a": "https://User@host.com/a",
        "https://:@Host.com:443/a": "https://host.com/a",
        "https://h.com\\a\\b/": "https://h.com/a/b",
        "https://h.com/s?q=%zz%20y&ref=1": "https://h.com/s?q=%25zz+y",
        "https://h.com/s?q=100%&b=%C3%A9&utm_source=x": "https://h.com/s?q=100%25&b=%C3%A9",
    }
    got = one(spark, canonical_url(F.col("x")), rows=[(k,) for k in cases])
    assert got == list(cases.values())
