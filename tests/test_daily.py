"""The daily edition end to end: landed inputs -> candidates and prompts ->
checked answers -> written edition."""

import datetime as dt
import json

from broadsheet.plans.daily import accept, accept_repos, prepare, prepare_repos, publish
from broadsheet.sources.editions import read_editions
from broadsheet.sources.landed import STORY_ANSWER_SCHEMA

D = dt.date(2026, 7, 18)
AS_OF = dt.datetime(2026, 7, 18, 5, 0)


def _rss(n):
    items = "".join(f"<item><title>Noticia {i}</title><link>https://n.example/{i}</link>"
                    f"<pubDate>Sat, 18 Jul 2026 0{i % 5}:00:00 GMT</pubDate><description>Texto {i}</description></item>"
                    for i in range(1, n + 1))
    return f'<?xml version="1.0"?><rss version="2.0"><channel><title>A</title>{items}</channel></rss>'


def _answer(urls, ranks):
    items = [{"rank": r, "category": "industria", "title": f"T{r}", "summary": "S", "why_it_matters": "W",
              "url": u, "source": "A"} for r, u in zip(ranks, urls)]
    return json.dumps({"date": "x", "generated_at": "y", "provider": "z", "items": items})


def test_daily_edition(spark, tmp_path):
    runs = spark.createDataFrame([(D, AS_OF, "DeepSeek")], "edition_date date, as_of timestamp, provider string")
    docs = spark.createDataFrame([(D, AS_OF, "Feed A", 0, _rss(8)), (D, AS_OF, "Feed B", 1, "<rss><oops")],
                                 "edition_date date, as_of timestamp, source string, source_ordinal int, body string")
    stories = spark.createDataFrame(
        [(D, AS_OF, "ai", 1, [("Dup", "https://n.example/1?utm_source=hn", 120, int(AS_OF.timestamp()) - 60, "9")])],
        STORY_ANSWER_SCHEMA)
    para = "<p>" + "Texto largo del articulo. " * 5 + "</p>"
    pages = spark.createDataFrame([(0, D - dt.timedelta(1), "https://n.example/1", 200, "text/html", f"<html>{para.replace('Texto', 'Ayer')}</html>"),
                                   (1, D, "https://n.example/1", 200, "text/html", f"<html>{para}</html>")],
                                  "page_id long, edition_date date, url string, status int, content_type string, html string")
    out = prepare(docs, pages, runs, story_answers=stories)
    status = {r["source"]: (r["ok"], r["n_items"]) for r in out["source_status"].collect()}
    assert status == {"Feed A": (True, 8), "Feed B": (False, 0), "Hacker News": (True, 1)}
    assert [r["status"] for r in out["run_status"].collect()] == ["ready"]
    cands = {r["url"]: r for r in out["candidates"].collect()}
    assert len(cands) == 8 and cands["https://n.example/1"]["points"] == 120
    assert cands["https://n.example/1"]["position"] == 1 and cands["https://n.example/1"]["content"].startswith("Texto")
    prompt = out["prompts"].collect()[0]["prompt"]
    assert "- provider: deepseek" in prompt and "1. [Feed A] (120 pts) Noticia 1" in prompt

    urls = [f"https://n.example/{i}" for i in range(1, 9)]
    responses = spark.createDataFrame(
        [(D, "digest", "", 1, _answer(urls[:6], [1, 1, 2, 3, 4, 5])),
         (D, "digest", "", 2, _answer(urls[:6], [1, 2, 3, 4, 5, 6])),
         (D, "item_social", "1", 1, '{"hook_x": "Gancho", "hook_linkedin": "Idea", "hashtags": ["IA"]}')],
        "edition_date date, call_kind string, key string, attempt int, raw string")
    acc = accept(responses, out["candidates"], runs)
    assert [r["attempt"] for r in acc["accepted"].collect()] == [2]
    assert acc["retry_prompts"].count() == 0 and acc["post_requests"].count() == 6
    trending = spark.createDataFrame([(D, k, f"o/{n}", f"https://g.example/{n}", f"about {n}", "Go", 7) for k, n in enumerate("abc")],
                                     "edition_date date, seq long, name string, url string, description string, language string, stars long")
    archive = spark.createDataFrame([((D - dt.timedelta(days=3)).isoformat(), [("o/b",)]), ((D - dt.timedelta(days=8)).isoformat(), [("o/a",)])],
                                    "date string, repos array<struct<name string>>")
    repos = prepare_repos(trending, archive=archive)
    assert "o/b" not in repos["prompts"].collect()[0]["prompt"] and repos["trending"].count() == 2
    picked = spark.createDataFrame([(D, "repos", "", 1, json.dumps({"repos": [
        {"name": "o/c", "description": "c in words"}, {"name": 7}, {"name": "o/a", "description": 5}, {"name": "o/b", "description": "kept out"}]}))],
        responses.schema)
    chosen = accept_repos(picked, repos["trending"])
    assert sorted(r["key"] for r in chosen["post_requests"].collect()) == ["o/a", "o/c"]
    written = publish(acc["accepted"], responses, runs, str(tmp_path / "editions"), chosen["picks"])
    assert written.count() == 1
    ed = read_editions(spark, str(tmp_path / "editions")).collect()[0]
    assert ed["date"] == "2026-07-18" and ed["provider"] == "deepseek" and len(ed["items"]) == 6
    assert ed["items"][0]["social"]["x"] == "Gancho\n\n#IA\nhttps://n.example/1" and ed["items"][1]["social"] is None
    assert [(r["name"], r["description"]) for r in ed["repos"]] == [("o/c", "c in words"), ("o/a", "about a")]
    again = publish(acc["accepted"], responses, runs, str(tmp_path / "editions"))
    assert again.count() == 0


def test_retry_prompt_lists_every_candidate(spark):
    runs = spark.createDataFrame([(D, AS_OF, "DeepSeek")], "edition_date date, as_of timestamp, provider string")
    cands = spark.createDataFrame([(D, k, f"https://n.example/{k}", "A", None, f"T{k}", None, "S") for k in range(1, 251)],
                                  "edition_date date, position int, url string, source string, points long, title string, content string, snippet string")
    bad = spark.createDataFrame([(D, "digest", "", 1, "{}")], "edition_date date, call_kind string, key string, attempt int, raw string")
    prompt = accept(bad, cands, runs)["retry_prompts"].collect()[0]["prompt"]
    assert "(250)" in prompt and "250. [A] T250" in prompt
