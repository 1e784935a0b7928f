"""Accepted answer -> edition document -> written edition."""

import datetime as dt
import json

from pyspark.sql import functions as F

from broadsheet.operators.edition import accepted_items, assemble_editions
from broadsheet.sources.editions import read_editions, write_editions

D = dt.date(2026, 7, 18)


def test_assemble_and_write(spark, tmp_path):
    items = [{"rank": 2, "category": "industria", "title": "Second", "summary": "s", "why_it_matters": "w",
              "url": "https://n.example/2", "source": "S",
              "social": {"x": "from answer", "linkedin": "from answer"}},
             {"rank": 1, "category": "herramientas", "title": "First", "summary": "s", "why_it_matters": "w",
              "url": "https://n.example/1", "source": "S"}]
    acc = spark.createDataFrame([(D, json.dumps(items))], "edition_date date, raw string") \
        .select("edition_date", F.try_variant_get(F.try_parse_json("raw"), "$", "array<variant>").alias("items"))
    typed = accepted_items(acc)
    rows = {r["rank"]: r for r in typed.collect()}
    assert rows[2]["pos"] == 1 and rows[2]["answer_social"]["x"] == "from answer" and rows[1]["answer_social"] is None
    posted = typed.withColumn("social", F.when(F.col("rank") == 1, F.struct(F.lit("X1").alias("x"),
                                                                              F.lit("L1").alias("linkedin"))))
    runs = spark.createDataFrame([(D, "2026-07-18", "2026-07-18T05:00:00.000Z", "deepseek")],
                                 "edition_date date, date string, generated_at string, provider string")
    repos = spark.createDataFrame([(D, 2, "o/b", "https://github.com/o/b", "B", None, None),
                                   (D, 1, "o/a", "https://github.com/o/a", "A", "Go", 10)],
                                  "edition_date date, seq long, name string, url string, description string, "
                                  "language string, stars bigint")
    doc = assemble_editions(posted, runs, repos).collect()[0]
    assert [i["title"] for i in doc["items"]] == ["Second", "First"]
    assert [i["social"]["x"] for i in doc["items"]] == ["from answer", "X1"]
    assert [r["name"] for r in doc["repos"]] == ["o/a", "o/b"] and doc["repos"][0]["social"] is None
    assert doc["generated_at"] == "2026-07-18T05:00:00.000Z"
    folder = str(tmp_path / "editions")
    write_editions(assemble_editions(posted, runs, repos), folder)
    back = read_editions(spark, folder).collect()[0]
    assert back["edition_date"] == D and [r["name"] for r in back["repos"]] == ["o/a", "o/b"]
    no_repos = assemble_editions(posted, runs).collect()[0]
    assert no_repos["repos"] is None
