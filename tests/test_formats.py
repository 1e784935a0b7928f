"""Formats of the schema and lenient feed dates against literals."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from broadsheet.functions.dates import lenient_date, parse_feed_date
from broadsheet.functions.formats import is_date, is_date_time, is_uri
from conftest import one

URIS = {
    "https://x.example/a": True, "https://x.example": True, "http://x.example/%zz": False, "https://x/<a>": False, "https://x/%4": False,
    "https://x/a b": False, "https://x/\u00e9": False, "https://x/%C3%A9?q=1&r=[2]": False, "https://x/?q=a/b?c": True, "https://x/#f/?": True,
    "https://x/#a#b": False, "https://u:p@x:80/": True, "https://u@v@x/": False, "https://x:8a/": False, "https://x:/": True, "http:///path": True,
    "https://[::1]/": True, "https://[1:2:3:4:5:6:7:8]:80/": True, "https://[1:2:3:4:5:6:7]/": False, "https://[::1::]/": False,
    "https://[1:2:3:4:5:6:7::]/": True, "https://[::ffff:1.2.3.4]/": True, "https://[::1.2.3.256]/": False, "https://[v1.a:b]/": True,
    "https://[12345::]/": False, "mailto:a@b.example": True, "urn:isbn:1": True, "//x/a": False, "x.example/a": False, "": False, "a:": True,
    "1a:b": False, "https://x/a\n": False, "https://x/{a}": False, "https://x/a|b": False, "https://x/a\\b": False, "https://x/~a_b-c.d!$&'()*+,;=:@": True,
    "https://x/" + "a" * 30_000: True, "https://x/" + "%41" * 10_000 + "%": False, "https://x/^": False, "https://a%20b/": True,
}
TIMES = {
    "2026-07-18T05:00:00Z": True, "2026-07-18t05:00:00.123z": True, "2026-07-18 05:00:00+02:00": True, "2026-07-18T05:00:00": False, "2026-07-18": False,
    "2026-02-29T05:00:00Z": False, "2024-02-29T05:00:00Z": True, "2026-07-18T24:00:00Z": False, "2026-07-18T23:59:60Z": True, "2026-07-18T23:58:60Z": False,
    "2026-07-19T01:59:60+02:00": True, "2026-07-18T05:60:00Z": False, "2026-07-18T05:00Z": False, "2026-07-18T05:00:00+24:00": False, "2026-13-01T05:00:00Z": False,
    "2026-07-18T05:00:00.Z": False, "26-07-18T05:00:00Z": False, "2026-07-18T05:00:00Z\n": False, "": False, "hoy": False, "2026-07-18T05:00:00-00:30": True,
}


def test_uri_table(spark):
    assert len(URIS) >= 40
    df = spark.createDataFrame([*[(u,) for u in URIS], (None,)], "s string")
    got = {r.s: r.ok for r in df.select("s", is_uri(F.col("s")).alias("ok")).collect()}
    assert got == {**URIS, None: False}


def test_date_time_table(spark):
    got = one(spark, is_date_time(F.col("s")), schema="s string", rows=[(t,) for t in [*TIMES, None]])
    assert got == [*TIMES.values(), False]
    days = {"2026-07-18": True, "2026-02-30": False, "2026-7-18": False, "2026-07-18T": False, "0000-01-01": True}
    got = one(spark, is_date(F.col("s")), schema="s string", rows=[(t,) for t in days])
    assert got[:4] == [*days.values()][:4]


def utc(*a):
    return dt.datetime(*a, tzinfo=dt.timezone.utc).replace(tzinfo=None)


DATES = {
    "Jul 1, 2026": utc(2026, 7, 1), "July 1, 2026 3:04 PM": utc(2026, 7, 1, 15, 4), "1 July 2026": utc(2026, 7, 1), "Sat, 18 Jul 2026": utc(2026, 7, 18),
    "Sat, 18 Jul 2026 05:00:00 EDT": utc(2026, 7, 18, 9), "Sat, 18 Jul 2026 05:00 PST": utc(2026, 7, 18, 13), "Saturday, July 18, 2026 12:00 am UTC": utc(2026, 7, 18),
    "Sat Jul 18 2026 05:00:00 GMT+0200 (CEST)": utc(2026, 7, 18, 3), "2026 Jul 18": utc(2026, 7, 18), "7/18/2026": utc(2026, 7, 18), "7/18/26 10:00": utc(2026, 7, 18, 10),
    "2026/07/18 10:00:05": utc(2026, 7, 18, 10, 0, 5), "18 Jul 49": utc(2049, 7, 18), "18 Jul 50": utc(1950, 7, 18), "Feb 30, 2026": utc(2026, 3, 2),
    "Jul 18, 2026 13:00 pm": None, "Jul 18, 2026 25:00": None, "Jul 32, 2026": None, "soon": None, "": None, "Jul 18 2026 maybe": None, "18/07/2026": None,
    "Jul Aug 1, 2026": None, "Jul 18, 2026 10:00 -0330": utc(2026, 7, 18, 13, 30), "18 Juli 2026": utc(2026, 7, 18), "Jul 18, 2026 24:00": utc(2026, 7, 19),
}


@pytest.mark.parametrize("read", [lenient_date, parse_feed_date])
def test_free_dates(spark, read):
    rows = [(t,) for t in DATES]
    assert one(spark, read(F.col("s")), schema="s string", rows=rows) == [*DATES.values()]


def test_known_shapes_are_read_as_before(spark):
    shapes = {"2026-07-18T05:00:00Z": utc(2026, 7, 18, 5), "2026-07-18": utc(2026, 7, 18), "Sat, 18 Jul 2026 05:00:00 +0200": utc(2026, 7, 18, 3),
              "18 Jul 26 05:00 GMT": utc(2026, 7, 18, 5), "Mon, 18 Jul 2026 05:00:00 GMT": utc(2026, 7, 18, 5), "2026-07-18T05": utc(2026, 7, 18, 5), "2026-99-18": None}
    got = one(spark, parse_feed_date(F.col("s")), schema="s string", rows=[(t,) for t in shapes])
    assert got[:5] == [*shapes.values()][:5] and got[6] is None
