"""Answer acceptance: schema rules, invented URLs, ranks, attempts."""

import datetime as dt
import json

from pyspark.sql import functions as F

from broadsheet.operators.validate import check_attempts, first_valid, resolve_provider, retry_prompts
from conftest import one

D = dt.date(2026, 7, 18)
URLS = [f"https://in.example/{i}" for i in range(8)]


def item(i, **over):
    it = {"rank": i + 1, "category": "industria", "title": f"T{i}", "summary": "S", "why_it_matters": "W",
          "url": URLS[i], "source": "Src"}
    it.update(over)
    return it


def digest(items, **root):
    return json.dumps({"date": "x", "generated_at": "y", "provider": "z", "items": items, **root})


def check(spark, raws):
    att = spark.createDataFrame([(D, i + 1, r) for i, r in enumerate(raws)], "edition_date date, attempt int, raw string")
    inputs = spark.createDataFrame([(D, URLS)], "edition_date date, urls array<string>")
    runs = spark.createDataFrame([(D, "2026-07-18", "2026-07-18T05:00:00.000Z", "deepseek")],
                                 "edition_date date, date string, generated_at string, provider string")
    return {r["attempt"]: r for r in check_attempts(att, inputs, runs).collect()}


def test_rules(spark):
    six = [item(i) for i in range(6)]
    raws = [
        digest(six),                                                   # 1 valid
        digest(six[:5]),                                               # 2 too few
        digest([item(0, category="otros")] + six[1:]),                 # 3 bad category
        digest(six + [item(6, url="https://made.up/x")]),              # 4 invented url dropped -> valid
        digest(six[:5] + [item(5, url="https://made.up/y")]),          # 5 dropped -> too few
        digest([{k: v for k, v in item(0).items() if k != "url"}] + six[1:]),  # 6 missing url kept
        digest([item(0, rank=2)] + six[1:]),                           # 7 repeated rank
        digest([item(0, rank="1")] + six[1:]),                         # 8 string rank
        digest([item(0, rank=1.0)] + six[1:]),                         # 9 1.0 is an integer
        digest([item(0, extra=True)] + six[1:]),                       # 10 extra key
        "no es JSON",                                                  # 11
        "[1, 2]",                                                      # 12
        "```json\n" + digest(six) + "\n```",                           # 13 fenced valid
        digest(six, bonus=1),                                          # 14 extra root key
        digest(six[:5] + [None]),                                      # 15 null item
        digest([item(0, social={"x": "post", "linkedin": ""})] + six[1:]),  # 16 empty social text
    ]
    r = check(spark, raws)
    assert r[1]["ok"] and r[1]["errors"] == []
    assert r[2]["errors"] == ["V3:min"]
    assert r[3]["errors"] == ["V4:items[0].category"]
    assert r[4]["ok"] and r[4]["n_dropped"] == 1 and len(r[4]["items"]) == 6
    assert r[5]["errors"] == ["V3:min"] and r[5]["n_dropped"] == 1
    assert r[6]["errors"] == ["V4:items[0].required:url"] and r[6]["n_dropped"] == 0
    assert r[7]["errors"] == ["A4:rank"]
    assert r[8]["errors"] == ["V4:items[0].rank"]
    assert r[9]["ok"]
    assert r[10]["errors"] == ["V4:items[0].extra:extra"]
    assert r[11]["errors"] == ["F12:json"]
    assert r[12]["errors"] == ["V1:type"]
    assert r[13]["ok"]
    assert r[14]["errors"] == ["V1:extra:bonus"]
    assert r[15]["errors"] == ["V4:items[5].type"]
    assert r[16]["errors"] == ["V5:items[0].social"]


def test_first_valid_and_retry(spark):
    six = [item(i) for i in range(6)]
    r = check(spark, [digest(six[:5]), digest(six), digest(six)])
    import pyspark.sql.functions as F2  # noqa: F401
    att = spark.createDataFrame([(D, a, raw) for a, raw in [(1, digest(six[:5])), (2, digest(six)), (3, digest(six))]],
                                "edition_date date, attempt int, raw string")
    inputs = spark.createDataFrame([(D, URLS)], "edition_date date, urls array<string>")
    runs = spark.createDataFrame([(D, "2026-07-18", "2026-07-18T05:00:00.000Z", "deepseek")],
                                 "edition_date date, date string, generated_at string, provider string")
    checked = check_attempts(att, inputs, runs)
    assert [x["attempt"] for x in first_valid(checked).collect()] == [2]
    base = spark.createDataFrame([(D, "BASE")], "edition_date date, prompt string")
    rp = retry_prompts(checked, base).collect()
    assert len(rp) == 1 and rp[0]["attempt"] == 2 and rp[0]["prompt"].startswith("BASE\n\n---\n")
    assert rp[0]["prompt"].endswith("JSON:\n- V3:min")
    assert r[1]["errors"] == ["V3:min"]


def test_provider_choice(spark):
    got = one(spark, resolve_provider(F.col("x")), rows=[("Claude-Code",), ("other",), (None,)])
    assert got == ["claude-code", "deepseek", "deepseek"]


def test_checks_of_a_file_with_one_row_group_run_in_many_tasks(spark, tmp_path):
    from broadsheet.plans.queries_rules import post_and_repo_checks

    rows = [(k % 40, k % 7 + 1) for k in range(400)] + [(None, 1), (5, None), (5, None)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    got = post_and_repo_checks(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(str(r["p_partkey"]) for r in got) == sorted(str(k) for k, _ in rows)
    assert len({r["task"] for r in got}) > 1
    assert {r["errors"] for r in got if r["p_partkey"] == 7} == {"", "V6:max", "V6:repos[0].required:url", "V6:repos[1].language,V6:repos[1].stars", "V6:type", "V6:repos[0].social,V6:repos[0].stars,V6:repos[1].type", "V6:repos[0].description,V6:repos[0].extra:z,V6:repos[0].name,V6:repos[0].url"}


def test_odd_objects(spark):
    six = [item(i) for i in range(6)]
    r = check(spark, ["null", "{}", '{"items":null}', digest([{}, [], "s"] + six[3:]), digest([item(0, social=[1], rank=None)] + six[1:]),
                      digest(six, repos=[None, {}, {"name": 1, "url": None, "description": "d", "social": {}}])])
    assert r[1]["errors"] == ["V1:type"] and r[2]["errors"] == ["V1:required:items"] and r[3]["errors"] == ["V3:type"]
    assert r[4]["errors"] == sorted(["V4:items[1].type", "V4:items[2].type"] + [f"V4:items[0].required:{k}" for k in item(0)])
    assert r[5]["errors"] == ["V4:items[0].rank", "V5:items[0].social"]
    assert r[6]["errors"] == sorted(["V6:repos[0].type"] + [f"V6:repos[1].required:{k}" for k in ("name", "url", "description")]
                                    + [f"V6:repos[2].{k}" for k in ("name", "social", "url")])
