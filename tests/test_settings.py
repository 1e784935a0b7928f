"""Configuration as data, two-step top-k, the pruned archive, claims and run status."""

import datetime as dt
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from broadsheet.operators.ingest import idle_runs
from broadsheet.operators.repos import drop_recent, recent_by_edition
from broadsheet.operators.topk import top_per_group
from broadsheet.plans.daily import accept_repos, prepare, prepare_repos
from broadsheet.sources import editions as E
from broadsheet.sources.config import CONFIG_SCHEMA, edition_settings, largest, read_config, story_queries
from broadsheet.sources.landed import MODEL_ANSWER_SCHEMA, STORY_ANSWER_SCHEMA
from broadsheet.sources.trending import search_repos

D = dt.date(2026, 7, 18)
DAY = dt.timedelta(days=1)
AS_OF = dt.datetime(2026, 7, 18, 5, 0)
DOC = "edition_date date, date string, generated_at string, provider string, items array<struct<rank int>>, repos array<struct<name string>>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_per_group_equals_a_plain_cut(spark):
    rng = random.Random(2)
    rows = [(g, rng.randrange(50), i) for i in range(3000) for g in ["hot" if i % 3 else f"g{i % 40}"]]
    k = {"hot": 70, "g0": 0, "g3": None}
    df = spark.createDataFrame([(g, v, i, k.get(g, 4)) for g, v, i in rows], "g string, v int, id long, k int")
    for limit, most in ((5, None), (F.col("k"), 70)):
        got = top_per_group(df, ["g"], [F.desc("v"), F.col("id")], limit, "n", ["id"], most, parts=8)
        want = set()
        for g in {r[0] for r in rows}:
            best = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
            want |= {(g, i, n) for n, (_, _, i) in enumerate(best[:5 if most is None else k.get(g, 4) or 0], 1)}
        assert {(r.g, r.id, r.n) for r in got.collect()} == want
        assert plan(got).count("WindowGroupLimit") >= 4
    with pytest.raises(ValueError):
        top_per_group(df, ["g"], [F.col("v")], F.col("k"), "n", ["id"])


def test_hot_group_is_cut_in_parts_before_it_meets(spark):
    """A group with all rows: no task of the last step reads more than parts x k rows."""
    df = spark.range(200_000).select(F.lit("hot").alias("g"), F.col("id"))
    got = top_per_group(df.repartition(40), ["g"], [F.desc("id")], 10, "n", ["id"], parts=64)
    met = got._jdf.queryExecution()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = top_per_group(df.repartition(40), ["g"], [F.desc("id")], 10, "n", ["id"], parts=64)
        assert [r.id for r in got.orderBy("n").collect()] == list(range(199_999, 199_989, -1))
        moved, todo = [], [got._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            if node.nodeName() == "Exchange":
                moved.append(node.metrics().apply("shuffleRecordsWritten").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
        assert min(moved) <= 64 * 10 and sorted(moved)[1] <= 40 * 64 * 10
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert met is not None


def _archive(spark, folder, days, back=1):
    docs = [(D - DAY * k, (D - DAY * k).isoformat(), "g", "deepseek", [(1,)], [(f"r{k}",), ("",), (None,)]) for k in range(back, back + days)]
    return E.write_editions(spark.createDataFrame(docs, DOC), folder)


def test_archive_is_read_for_seven_days_only(spark, tmp_path):
    folder = str(tmp_path / "archive")
    _archive(spark, folder, 60)
    runs = spark.createDataFrame([(D,)], "edition_date date")
    recent = recent_by_edition(E.read_editions(spark, folder), runs)
    assert "dynamicpruning" in plan(recent)
    assert sorted(r["name"] for r in recent.collect()) == sorted(f"r{k}" for k in range(1, 8))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        recent = recent_by_edition(E.read_editions(spark, folder), runs)
        recent.collect()
        todo, files = [recent._jdf.queryExecution().executedPlan()], None
        while todo:
            node = todo.pop()
            if node.nodeName().startswith("Scan json"):
                files = node.metrics().apply("numFiles").value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
        assert files == 7
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    trending = spark.createDataFrame([(D, f"r{k}", k) for k in range(12)], "edition_date date, name string, seq int")
    assert sorted(r["seq"] for r in drop_recent(trending, recent).collect()) == [0, 8, 9, 10, 11]
    assert recent_by_edition(E.read_editions(spark, str(tmp_path / "none")), runs).collect() == []


def test_two_writers_write_each_edition_once(spark, tmp_path):
    folder = str(tmp_path / "out")
    docs = spark.createDataFrame([(D - DAY * k, str(k), "g", "p", [(1,)], None) for k in range(4)], DOC)
    got, failed = [], []

    def write():
        try:
            got.append(E.write_editions(docs, folder).count())
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and sum(got) == 4
    assert E.read_editions(spark, folder).count() == 4
    assert E.write_editions(docs, folder).count() == 0


def test_claims_are_exclusive_and_stale_ones_are_taken_over(spark, tmp_path):
    folder = str(tmp_path / "out")
    assert E.claim(spark, folder, D) and not E.claim(spark, folder, D)
    docs = spark.createDataFrame([(D, "x", "g", "p", [(1,)], None)], DOC)
    assert E.write_editions(docs, folder).count() == 0  # another writer is at it
    assert E.write_editions(docs, folder, stale_seconds=-1).count() == 1  # it died
    assert E.claim(spark, folder, D)
    E.release(spark, folder, D)
    assert E.published_dates(spark, folder).count() == 1


def _config(day=None, **changes):
    c = {"window_hours": 24, "candidate_cap": 3, "enrich_top": 1,
         "rss": [{"id": "a", "name": "Feed A", "url": "u", "enabled": True, "fragile": False},
                 {"id": "b", "name": "Feed B", "url": "u", "enabled": True, "fragile": True},
                 {"id": "c", "name": "Feed C", "url": "u", "enabled": False, "fragile": False}],
         "hackernews": {"enabled": True, "min_points": 100, "queries": ["x", "y"]},
         "huggingface_trending": {"enabled": True, "limit": 1}, "github_trending": {"enabled": True, "limit": 2, "pick": 1}, **changes}
    return c if day is None else {"edition_date": day.isoformat(), **c}


def _frame(spark, *configs, day=True):
    schema = ("edition_date date, " if day else "") + CONFIG_SCHEMA
    return spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(c) for c in configs]))


def _rss(n, day="18"):
    return "<rss><channel>" + "".join(f"<item><title>N{i}</title><link>https://n.example/{i}</link><pubDate>Sat, {day} Jul 2026 01:00:0{i % 10} GMT</pubDate></item>"
                                      for i in range(n)) + "</channel></rss>"


def test_settings_per_edition_with_defaults(spark, tmp_path):
    runs = spark.createDataFrame([(D,), (D + DAY,), (D + DAY * 2,)], "edition_date date")
    config = _frame(spark, _config(D), {"edition_date": (D + DAY).isoformat(), "candidate_cap": 250})
    got = {r.edition_date: r for r in edition_settings(config, runs).collect()}
    assert (got[D].candidate_cap, got[D].min_points, got[D].pick, got[D].stories_enabled) == (3, 100, 1, True)
    assert (got[D + DAY].candidate_cap, got[D + DAY].window_hours, got[D + DAY].stories_enabled) == (250, 24, False)
    assert (got[D + DAY * 2].candidate_cap, got[D + DAY * 2].pick) == (200, 5)
    assert largest(edition_settings(config, runs))["candidate_cap"] == 250
    path = tmp_path / "c.json"
    path.write_text(json.dumps(_config(), indent=1))
    one = read_config(spark, str(path))
    assert [r.candidate_cap for r in edition_settings(one, runs).collect()] == [3, 3, 3]
    assert [tuple(r) for r in story_queries(config).collect()] == [(D, 1, "x"), (D, 2, "y")]


def test_prepare_follows_each_editions_configuration(spark):
    runs = spark.createDataFrame([(D, AS_OF, "x", True), (D + DAY, AS_OF + DAY, "x", True), (D + DAY * 2, AS_OF, "x", True), (D + DAY * 3, AS_OF, "x", False)],
                                 "edition_date date, as_of timestamp, provider string, has_credential boolean")
    config = _frame(spark, _config(D), _config(D + DAY, candidate_cap=7, window_hours=60, enrich_top=2, hackernews={"enabled": False}, huggingface_trending=None))
    bodies = [("Feed A", 1, _rss(9)), ("Feed B", 0, "<rss"), ("Feed C", 2, _rss(3).replace("n.example", "c.example"))]
    docs = spark.createDataFrame([(d, a, s, o, b) for d, a in ((D, AS_OF), (D + DAY, AS_OF + DAY), (D + DAY * 2, AS_OF), (D + DAY * 3, AS_OF)) for s, o, b in bodies],
                                 "edition_date date, as_of timestamp, source string, source_ordinal int, body string")
    at = int(AS_OF.timestamp()) - 60
    stories = spark.createDataFrame([(d, a, "q", 1, [("S", "https://s.example/1", 120, at, "1"), ("T", "https://s.example/2", 90, at, "2")])
                                     for d, a in ((D, AS_OF), (D + DAY, AS_OF))], STORY_ANSWER_SCHEMA)
    models = spark.createDataFrame([(d, AS_OF, [("m/1", None, 1, 1, None), ("m/2", None, 1, 1, None)]) for d in (D, D + DAY)], MODEL_ANSWER_SCHEMA)
    para = "<p>" + "Texto largo del articulo. " * 5 + "</p>"
    pages = spark.createDataFrame([(k, D + DAY, f"https://n.example/{k}", 200, "text/html", para) for k in range(9)],
                                  "page_id long, edition_date date, url string, status int, content_type string, html string")
    published = spark.createDataFrame([(D + DAY * 2,)], "edition_date date")
    out = prepare(docs, pages, runs, story_answers=stories, model_answers=models, config=config, published=published)
    cands = out["candidates"].collect()
    first = sorted((r.position, r.url) for r in cands if r.edition_date == D)
    assert len(first) == 3 and first[0] == (1, "https://s.example/1")
    second = [r for r in cands if r.edition_date == D + DAY]
    assert len(second) == 7 and sum(r.content is not None for r in second) == 2
    items = out["collected"].collect()
    assert {r.source for r in items if r.edition_date == D} == {"Feed A", "Hacker News", "Hugging Face (trending)"}
    assert sum(r.source.startswith("Hugging") for r in items) == 1 and not any("s.example/2" in r.url for r in items)
    assert {r.source for r in items if r.edition_date == D + DAY} == {"Feed A"}
    status = {r.edition_date: r.status for r in out["run_status"].collect()}
    assert status == {D: "ready", D + DAY: "ready", D + DAY * 2: "published", D + DAY * 3: "skipped"}
    failures = {(r.edition_date, r.source): (r.level, bool(r.reason)) for r in out["source_failures"].collect()}
    assert failures == {(D, "Feed B"): ("ignored", True), (D + DAY, "Feed B"): ("ignored", True)}
    assert {r.edition_date for r in out["prompts"].collect()} == {D, D + DAY}


def test_repos_follow_the_configuration(spark, tmp_path):
    folder = str(tmp_path / "archive")
    _archive(spark, folder, 3)
    schema = "edition_date date, seq long, name string, url string, description string, language string, stars long"
    rows = [(d, k, f"r{k}", f"u{k}", "about", "Go", 7) for d in (D, D + DAY) for k in range(6)]
    config = _frame(spark, _config(D, github_trending={"enabled": True, "limit": 4, "pick": 1}), _config(D + DAY, github_trending={"enabled": True, "limit": 6, "pick": 3}))
    got = prepare_repos(spark.createDataFrame([*rows, (D + DAY * 2, 1, "x", "u", "a", "b", 1)], schema), archive=E.read_editions(spark, folder), config=config)
    fresh = {(r.edition_date, r.name) for r in got["trending"].collect()}
    assert fresh == {(D, "r0")} | {(D + DAY, f"r{k}") for k in (0, 4, 5)}
    prompts = {r.edition_date: r.prompt for r in got["prompts"].collect()}
    assert "los 1 rep" in prompts[D] and "los 3 rep" in prompts[D + DAY] and set(prompts) == {D, D + DAY}
    answers = [(d, "repos", "", 1, json.dumps({"repos": [{"name": n} for n in ("r5", "r0", "r4", "r0")]})) for d in (D, D + DAY)]
    picks = accept_repos(spark.createDataFrame(answers, "edition_date date, call_kind string, key string, attempt int, raw string"), got["trending"])["picks"]
    assert sorted((r.edition_date, r.slot, r.name) for r in picks.collect()) == [(D, 1, "r0"), (D + DAY, 1, "r5"), (D + DAY, 2, "r0"), (D + DAY, 3, "r4")]


def test_published_editions_parse_no_feed(spark):
    runs = spark.createDataFrame([(D, AS_OF, "x")], "edition_date date, as_of timestamp, provider string")
    docs = spark.createDataFrame([(D, AS_OF, "Feed A", 0, _rss(9))], "edition_date date, as_of timestamp, source string, source_ordinal int, body string")
    pages = spark.createDataFrame([], "page_id long, edition_date date, url string, status int, content_type string, html string")
    out = prepare(docs, pages, runs, published=runs.select("edition_date"))
    assert out["collected"].count() == out["source_status"].count() == out["prompts"].count() == 0
    assert [tuple(r)[0::4] for r in out["run_status"].select("edition_date", "attempted", "succeeded", "failures", "status").collect()] == [(D, "published")]


def test_idle_runs(spark):
    runs = spark.createDataFrame([(D, True), (D + DAY, None), (D + DAY * 2, False)], "edition_date date, has_credential boolean")
    done = spark.createDataFrame([(D + DAY * 2,)], "edition_date date")
    assert sorted(map(tuple, idle_runs(runs, done).collect())) == [(D + DAY, "skipped"), (D + DAY * 2, "published")]
    assert idle_runs(runs.drop("has_credential")).count() == 0


def test_search_leaves_out_old_repositories(spark):
    item = "struct<full_name: string, html_url: string, description: string, language: string, stargazers_count: bigint, created_at: string>"
    items = [(f"o/{k}", None, None, None, k, t) for k, t in enumerate(
        ["2026-07-18T04:00:00Z", "2026-07-12T00:00:00Z", "2026-07-11T23:59:59Z", None, "soon", "2026-07-12T01:00:00+02:00"])]
    answers = spark.createDataFrame([(D, AS_OF, items)], f"edition_date date, as_of timestamp, items array<{item}>")
    assert [r.name for r in search_repos(answers).orderBy("seq").collect()] == ["o/0", "o/1"]
    plain = answers.select("edition_date", F.transform("items", lambda i: i.dropFields("created_at")).alias("items"))
    assert search_repos(plain).count() == 6
