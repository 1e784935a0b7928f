"""Landed answers, source union, archive files and post attachment
(S3, S4, S10, U1, S11, K1, K3, J6, A10, F23, F24)."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from broadsheet.operators.collect import collect_all
from broadsheet.operators.ingest import merge_story_hits, story_hits
from broadsheet.operators.social import attach_item_social, attach_repo_social, post_coverage, post_requests
from broadsheet.sources.editions import read_edition_files, read_editions, write_editions
from broadsheet.sources.landed import model_items, story_hit_rows, unwrap_answer, unwrap_chat, unwrap_cli
from conftest import one

D = dt.date(2026, 7, 18)
AS_OF = dt.datetime(2026, 7, 18, 5, 0, 0)
NOW_S = int((AS_OF - dt.datetime(1970, 1, 1)).total_seconds())


def test_story_hits_from_answers(spark):
    hit = "struct<title string, url string, points bigint, created_at_i bigint, objectID string>"
    answers = spark.createDataFrame([
        (D, AS_OF, "ai", 1, [("A", "https://a.example/x", 80, NOW_S - 60, "1"),
                             ("B", "https://b.example/", 10, NOW_S - 120, "2")]),
        (D, AS_OF, "llm", 2, [("A again", " https://a.example/x ", 120, NOW_S - 30, "3")]),
        (D, AS_OF, "broken", 3, None)],
        f"edition_date date, as_of timestamp, query string, query_ordinal int, hits array<{hit}>")
    rows = story_hit_rows(answers)
    assert rows.count() == 3
    merged = merge_story_hits(story_hits(rows, by=("edition_date",)), by=("edition_date",)).collect()
    assert [(r["url"], r["title"], r["points"]) for r in merged] == [("https://a.example/x", "A", 120)]


def test_model_items(spark):
    m = "struct<id string, modelId string, downloads bigint, likes bigint, lastModified string>"
    answers = spark.createDataFrame([(D, AS_OF, [
        ("org/one", None, 1200, None, "2026-07-10T08:00:00.000Z"),
        (None, "org/two", None, 7, None),
        ("", "org/three", 1, 1, None),
        (None, None, 1, 1, None),
        ("org/four", None, 3, 4, "not a date")])], f"edition_date date, as_of timestamp, models array<{m}>")
    got = model_items(answers).orderBy("item_ordinal").collect()
    assert [(r["item_ordinal"], r["title"], r["snippet"], r["url"]) for r in got] == [
        (1, "Modelo en tendencia: org/one", "Descargas: 1200, likes: ?", "https://huggingface.co/org/one"),
        (2, "Modelo en tendencia: org/two", "Descargas: ?, likes: 7", "https://huggingface.co/org/two"),
        (5, "Modelo en tendencia: org/four", "Descargas: 3, likes: 4", "https://huggingface.co/org/four")]
    assert got[0]["published_at"] == dt.datetime(2026, 7, 10, 8, 0)
    assert got[1]["published_at"] == AS_OF and got[2]["published_at"] is None
    assert {r["source"] for r in got} == {"Hugging Face (trending)"}


def test_unwrap_envelopes(spark):
    chat = [json.dumps({"choices": [{"message": {"content": "{\"a\":1}"}}]}),
            json.dumps({"choices": [{"message": {"content": ""}}]}),
            json.dumps({"choices": []}), "<html>502</html>"]
    assert one(spark, unwrap_chat(F.col("x")), rows=[(r,) for r in chat]) == ['{"a":1}', None, None, None]
    cli = [json.dumps({"structured_output": {"items": [1]}, "result": "ignored"}),
           json.dumps({"result": "```json\n{}\n```"}),
           json.dumps({"result": 5, "other": True}),
           json.dumps({"structured_output": None}),
           "plain text, not JSON"]
    got = one(spark, unwrap_cli(F.col("x")), rows=[(r,) for r in cli])
    assert json.loads(got[0]) == {"items": [1]}
    assert got[1] == "```json\n{}\n```"
    assert json.loads(got[2]) == {"result": 5, "other": True}
    assert got[3] == "null" and got[4] == "plain text, not JSON"
    df = spark.createDataFrame([(cli[1], "claude-code"), (chat[0], "deepseek")], "raw string, p string")
    assert [r[0] for r in df.select(unwrap_answer("raw", "p")).collect()] == ["```json\n{}\n```", '{"a":1}']


def test_collect_all_arrival_order(spark):
    ts = dt.datetime(2026, 7, 18, 1, 0)
    feeds = spark.createDataFrame([(D, 2, 1, "f21", "", "https://x/1", "S2", ts),
                                   (D, 0, 2, "f02", "", "https://x/2", "S0", ts),
                                   (D, 0, 1, "f01", "", "https://x/3", "S0", ts)],
                                  "edition_date date, source_ordinal int, item_ordinal int, title string, "
                                  "snippet string, url string, source string, published_at timestamp")
    stories = spark.createDataFrame([(D, (1, 3), "s13", "", "https://y/1", "HN", ts, 90),
                                     (D, (0, 9), "s09", "", "https://y/2", "HN", ts, 60)],
                                    "edition_date date, arrival struct<query_ordinal int, hit_pos int>, title string, "
                                    "snippet string, url string, source string, published_at timestamp, points bigint")
    models = spark.createDataFrame([(D, 1, "m1", "", "https://z/1", "HF", ts, None)],
                                   "edition_date date, item_ordinal int, title string, snippet string, url string, "
                                   "source string, published_at timestamp, points bigint")
    got = [r["title"] for r in collect_all(feeds, stories, models).orderBy("seq").collect()]
    assert got == ["f01", "f02", "f21", "s09", "s13", "m1"]


def _doc(date, ranks):
    return {"date": date, "generated_at": date + "T06:00:00.000Z", "provider": "deepseek",
            "items": [{"rank": r, "category": "industria", "title": f"T{r}", "summary": "s", "why_it_matters": "w",
                       "url": f"https://n.example/{r}", "source": "S"} for r in ranks]}


def test_read_edition_files(spark, tmp_path):
    folder = tmp_path / "data"
    folder.mkdir()
    (folder / "2026-07-17.json").write_text(json.dumps(_doc("2026-07-17", [2, 1]), indent=2))
    (folder / "2026-07-18.json").write_text(json.dumps(_doc("2026-07-18", [1])))
    (folder / "2026-07-19.json").write_text("{ not json")
    (folder / "notes.json").write_text(json.dumps(_doc("2026-07-20", [1])))
    (folder / "2026-07-21.json.bak").write_text(json.dumps(_doc("2026-07-21", [1])))
    got = sorted((r["date"], len(r["items"])) for r in read_edition_files(spark, str(folder)).collect())
    assert got == [("2026-07-17", 2), ("2026-07-18", 1)]
    assert read_edition_files(spark, str(tmp_path / "missing")).count() == 0


def test_write_editions_is_write_once(spark, tmp_path):
    folder = str(tmp_path / "editions")
    schema = read_editions(spark, folder).schema
    first = spark.createDataFrame([
        {**_doc("2026-07-17", [1, 2]), "repos": None, "edition_date": dt.date(2026, 7, 17)}], schema)
    assert write_editions(first, folder).count() == 1
    again = spark.createDataFrame([
        {**_doc("2026-07-17", [9]), "repos": None, "edition_date": dt.date(2026, 7, 17)},
        {**_doc("2026-07-18", [1]), "repos": None, "edition_date": dt.date(2026, 7, 18)}], schema)
    write_editions(again, folder)
    back = {r["date"]: [i["rank"] for i in r["items"]] for r in read_editions(spark, folder).collect()}
    assert back == {"2026-07-17": [1, 2], "2026-07-18": [1]}
    assert sorted(n for n in os.listdir(folder) if n.startswith("edition_date=")) == [
        "edition_date=2026-07-17", "edition_date=2026-07-18"]


def test_attach_social_best_effort(spark):
    items = spark.createDataFrame([(D, 1, "Sum one", "Why one", "https://n.example/1", "T1", "S"),
                                   (D, 2, "Sum two", "Why two", "https://n.example/2", "T2", "S"),
                                   (D, 3, "Sum three", "Why three", "https://n.example/3", "T3", "S"),
                                   (D, 4, "Sum four", "Why four", "https://n.example/4", "T4", "S")],
                                  "edition_date date, rank int, summary string, why_it_matters string, url string, "
                                  "title string, source string")
    responses = spark.createDataFrame([
        (D, "item_social", "1", 1, '```json\n{"hook_x": " Hook **x** ", "hook_linkedin": "Idea **clave**", '
                                   '"hashtags": ["IA", 5, "#", "#Datos"]}\n```'),
        (D, "item_social", "2", 1, '{"hook_x": 7, "hook_linkedin": ""}'),
        (D, "item_social", "3", 1, "no JSON here"),
        (D, "repo_social", "o/r", 1, "null")], "edition_date date, call_kind string, key string, attempt int, raw string")
    got = {r["rank"]: r["social"] for r in attach_item_social(items, responses).collect()}
    assert got[1]["x"] == "Hook **x**\n\n#IA #Datos\nhttps://n.example/1"
    assert got[1]["linkedin"] == "Idea 𝗰𝗹𝗮𝘃𝗲\n\n#IA #Datos\n\nhttps://n.example/1"
    assert got[2]["x"] == "Why two\nhttps://n.example/2" and got[2]["linkedin"] == "\n\nhttps://n.example/2"
    assert got[3] is None and got[4] is None
    repos = spark.createDataFrame([(D, "o/r", "Desc", "https://github.com/o/r", "Go", 10)],
                                  "edition_date date, name string, description string, url string, "
                                  "language string, stars bigint")
    assert attach_repo_social(repos, responses).collect()[0]["social"] is None
    cov = post_coverage(attach_item_social(items, responses)).collect()[0]
    assert (cov["n_posted"], cov["n_total"]) == (2, 4)


def test_post_requests(spark):
    items = spark.createDataFrame([(D, 1, "T", "S", "W", "Src")],
                                  "edition_date date, rank int, title string, summary string, why_it_matters string, "
                                  "source string")
    repos = spark.createDataFrame([(D, "o/r", "Desc", None, None, "https://github.com/o/r")],
                                  "edition_date date, name string, description string, language string, stars bigint, "
                                  "url string")
    got = {r["call_kind"]: r["prompt"] for r in post_requests(items, repos).collect()}
    assert got["item_social"].startswith("Noticia:\nTitular: T\nResumen: S\nPor qué importa: W\nFuente: Src\n\n")
    assert got["repo_social"].startswith("Repositorio:\nNombre: o/r\nDescripción: Desc\nURL: https://github.com/o/r\n\n")
