"""Readable article text."""

from pyspark.sql import functions as F

from broadsheet.functions.html import decode_entities, extract_readable, strip_html_repo, usable_text
from conftest import one

LONG = "This paragraph is long enough to count as readable text for the digest reader here."
HTML = f"""<html><head><meta property="og:description" content="Caf&#233; opens &amp; grows">
<script>var p = "<p>not text</p>";</script></head><body>
<p>tiny</p><p class="lead">{LONG}</p><P>{LONG.upper()}</P></body></html>"""


def test_extract_readable_meta_and_paragraphs(spark):
    got = one(spark, extract_readable(F.col("x")), rows=[(HTML,)])[0]
    assert got.startswith("Café opens & grows " + LONG)
    assert "tiny" not in got and "not text" not in got


def test_meta_name_fallback_and_cut(spark):
    html = '<meta content="Described here" name="description">' + "".join(f"<p>{LONG} {i}</p>" for i in range(20))
    got = one(spark, extract_readable(F.col("x")), rows=[(html,)])[0]
    assert got.startswith("Described here " + LONG)
    assert len(got) <= 1200
    assert got.count(LONG) == 8 or len(got) == 1200


def test_entity_passes(spark):
    rows = [("&#x41;&#66;&amp;C",), ("&amp;lt;b&amp;gt;",), ("&unknown; &NBSP;x",), ("&#1114112; &#xD800;",)]
    got = one(spark, decode_entities(F.col("x")), rows=rows)
    assert got == ["AB&C", "&lt;b&gt;", "&unknown;  x", "&#1114112; &#xD800;"]


def test_repo_strip_decodes_twice(spark):
    got = one(spark, strip_html_repo(F.col("x")), rows=[("<em>A</em> &amp;lt;tag&amp;gt;  &#39;q&#39;",)])
    assert got == ["A <tag> 'q'"]


def test_usable_threshold(spark):
    got = one(spark, usable_text(F.col("x")), rows=[("x" * 79,), ("y" * 80,)])
    assert got == [None, "y" * 80]


def test_meta_guard_is_case_insensitive(spark):
    from broadsheet.functions.html import meta_description
    html = '<META NAME="DESCRIPTION" CONTENT="Upper &amp; case">'
    assert one(spark, meta_description(F.col("x")), rows=[(html,), ("<p>no meta here</p>",)]) == ["Upper & case", ""]


def test_paragraphs_stop_after_eight(spark):
    from broadsheet.functions.html import readable_paragraphs
    para = lambda i: f"<P>Paragraph {i:02d} " + "x" * 60 + "</P>"
    html = "<p>short</p>" + "".join(para(i) for i in range(12)) + "<pre>" + "y" * 70 + "</pre>"
    got = one(spark, readable_paragraphs(F.col("x")), rows=[(html,)])[0]
    assert len(got) == 8 and got[0].startswith("Paragraph 00") and got[-1].startswith("Paragraph 07")


def test_text_belongs_to_the_edition_and_html_is_not_shuffled(spark):
    import datetime as dt

    from broadsheet.operators.enrich import enrich
    d1, d2 = dt.date(2026, 7, 1), dt.date(2026, 7, 2)
    ranked = spark.createDataFrame([(d, u, k) for d in (d1, d2) for k, u in enumerate(("https://n.example/a", "https://n.example/b"), 1)],
                                   "edition_date date, url string, position int")
    page = lambda day: f"<p>{LONG} Day {day}, read once more.</p>"
    pages = spark.createDataFrame(
        [(1, d1, "https://n.example/a", 200, "text/html", page(1)), (2, d2, "https://n.example/a?utm_source=x", 200, "text/html", page(2)),
         (3, d1, "https://n.example/b", 200, "text/html", page(1)), (4, d1, "https://n.example/a", 200, "text/html", page(9))],
        "page_id long, edition_date date, url string, status int, content_type string, html string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = enrich(ranked, pages, top=1)
        rows = {(r["edition_date"], r["position"]): r["content"] for r in got.collect()}
        plan = got._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Day 1" in rows[d1, 1] and "Day 2" in rows[d2, 1] and rows[d1, 2] is None and rows[d2, 2] is None
    joins = [i for i, line in enumerate(plan.splitlines()) if "Join" in line]
    extract = [i for i, line in enumerate(plan.splitlines()) if "<p" in line]
    assert joins and extract and min(extract) > max(joins)


def test_queries_enrich_the_production_limit(spark, tmp_path):
    from broadsheet.operators.enrich import ENRICH_TOP
    from broadsheet.plans.queries_enrich import enrich_rate, enriched_candidates
    # 40 pages of one edition (page_id % 30 = 1), all fetched as HTML.
    ids = [i for i in range(1, 3000, 30) if i % 11 and i % 13][:40]
    rows = [(i, f"https://e.example/{i}", f"<title>T{i}</title><p>{LONG}</p>") for i in ids]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = enriched_candidates(spark, str(tmp_path)).where("edition_date = '2024-01-02'").collect()
    assert len(got) == 40 and ENRICH_TOP == 30
    assert sorted(r["position"] for r in got if r["content"] is not None) == list(range(1, 31))
    rate = enrich_rate(spark, str(tmp_path)).where("edition_date = '2024-01-02'").collect()
    assert [(r["n_targets"], r["n_ok"]) for r in rate] == [(30, 30)]
