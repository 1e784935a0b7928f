from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline

from broadsheet.llm import mixing, quality
from broadsheet.llm.queries import QUERIES

from .conftest import DATA, table
from .test_neardup import slow_components, slow_fingerprint


def test_stages_do_their_work_on_what_is_left(spark, tmp_path):
    docs = table(spark, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "mixing", "packing"]
    stages = dict(corpus_pipeline.STAGES)

    good = stages["quality"](spark, docs, DATA)
    good.write.parquet(str(tmp_path / "good"))
    good = spark.read.parquet(str(tmp_path / "good"))
    scored = quality.score_documents(docs, table(spark, "labels")).where("predicted = 1")
    assert good.columns == docs.columns
    assert Counter(r["doc_id"] for r in good.collect()) == Counter(r["doc_id"] for r in scored.select("doc_id").collect())

    alone = stages["near_duplicates"](spark, good, DATA)
    alone.write.parquet(str(tmp_path / "alone"))
    alone = spark.read.parquet(str(tmp_path / "alone"))
    found = slow_components([(r["doc_id"], slow_fingerprint(r["text"])) for r in good.collect()])
    assert alone.columns == docs.columns
    assert Counter(r["doc_id"] for r in alone.collect()) == Counter({c: 1 for _, _, c in found})

    mixed = stages["mixing"](spark, alone, DATA)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter(r["doc_id"] for r in mixing.mixed_documents(alone).collect())
    last = stages["packing"](spark, mixed, DATA).collect()
    assert Counter(r["doc_id"] for r in last if r["piece"] == 0) == Counter(r["doc_id"] for r in mixed.collect())


def test_near_duplicate_stage_on_odd_rows(spark, odd_docs, no_docs):
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    got = stage(spark, odd_docs, DATA)
    assert got.columns == odd_docs.columns
    found = slow_components([(r["doc_id"], slow_fingerprint(r["text"])) for r in odd_docs.collect()])
    assert Counter(r["doc_id"] for r in got.collect()) == Counter({c: 1 for _, _, c in found})
    assert stage(spark, no_docs, DATA).collect() == []


def test_linked_rows_under_one_id_or_none_leave_one_row(spark):
    """Two linked texts under one id, a linked group with a null and a repeated id, and
    one whose ids are all null."""
    from broadsheet.llm import neardup
    base = " ".join(f"w{k}" for k in range(4000))
    near = base + " end"
    far = [" ".join(f"{x}{k}" for k in range(500)) for x in "abc"]
    assert bin((neardup.fingerprint(base) ^ neardup.fingerprint(near)) % 2 ** 64).count("1") <= 2
    rows = [(1, base), (1, near), (1, base), (2, base), (None, near), (None, far[0]), (None, far[0]), (5, far[1]), (5, far[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, DATA).collect()
    assert sorted((str(r.doc_id), r.text in (base, near), r.text == far[0]) for r in got) == [
        ("1", True, False), ("5", False, False), ("5", False, False), ("None", False, True)]


def test_documents_keep_their_own_columns(spark, tmp_path):
    """Columns that an operator adds by the same name keep the document's values."""
    own = {"score": 7.5, "held_out": "mine", "predicted": 3, "target": "t", "source_size": "s", "copies": -1, "fp": 1, "root": 2, "component_id": 3, "shard": 4}
    docs = table(spark, "documents")
    for name, value in own.items():
        docs = docs.withColumn(name, F.lit(value))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        assert set(own) <= set(docs.columns)
        assert docs.select(*own).distinct().collect() == [tuple(own.values())]


def test_every_stage_on_odd_and_no_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, DATA)
            rows = got.collect()
            assert name == "packing" or got.columns == odd_docs.columns
            assert rows == [] if docs is no_docs else name == "quality" or rows


def test_run_packs_what_the_stages_leave(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 0


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)]
