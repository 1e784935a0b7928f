"""Streaming candidates: the stream gives the batch result for every closed run."""

import datetime as dt

from pyspark.sql import functions as F

from broadsheet.operators.dedup import dedup_candidates, rank_per_edition
from broadsheet.streaming.candidates import LANDED_SCHEMA, start_candidates_stream, write_batch

RUN1 = dt.datetime(2026, 7, 17, 5, 0)
RUN2 = dt.datetime(2026, 7, 18, 5, 0)


def _items(run, day, n, offset=0):
    rows = []
    for i in range(n):
        url = f"https://n.example/{i % 7}" + ("?utm_source=x" if i % 3 == 0 else "")
        rows.append((run, day, offset + i, f"T{i}", "" if i % 2 else f"S{i}", url, "src",
                     run - dt.timedelta(minutes=i), None if i % 4 == 0 else (i * 13) % 29))
    return rows


def test_stream_matches_batch(spark, tmp_path):
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    d1, d2 = RUN1.date(), RUN2.date()
    first = spark.createDataFrame(_items(RUN1, d1, 20), LANDED_SCHEMA)
    late = spark.createDataFrame(_items(RUN1, d1, 6, offset=100), LANDED_SCHEMA)
    second = spark.createDataFrame(_items(RUN2, d2, 5), LANDED_SCHEMA)
    first.write.parquet(landing + "/a")
    late.write.mode("append").parquet(landing + "/a")
    second.write.parquet(landing + "/b")
    q = start_candidates_stream(spark, landing + "/*", out, name=f"t{id(tmp_path)}", cap=5, available_now=True)
    q.awaitTermination(120)
    got = spark.read.parquet(out).where(F.col("edition_date") == d1)
    want = rank_per_edition(dedup_candidates(first.unionByName(late).drop("as_of")), cap=5)
    cols = ["edition_date", "seq", "title", "snippet", "url", "source", "published_at", "points", "position"]
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())
    assert got.count() == 5


def test_a_replayed_batch_writes_no_row_twice(spark, tmp_path):
    out = str(tmp_path / "out")
    items = spark.createDataFrame(_items(RUN1, RUN1.date(), 20) + _items(RUN2, RUN2.date(), 9), LANDED_SCHEMA)
    for run in (RUN1, RUN2, RUN2):
        write_batch(items.where(F.col("as_of") == F.lit(run)), out, cap=5)
    got = spark.read.parquet(out)
    assert sorted((r["as_of"], r["position"]) for r in got.collect()) == [(r, k) for r in (RUN1, RUN2) for k in range(1, 6)]
