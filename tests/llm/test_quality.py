import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from broadsheet.llm import quality

from .conftest import table

DATA = "/root/testdata/sf0.01"


def test_held_out_documents_are_told_apart(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.score_documents(docs, labels).select("doc_id", "held_out", "score", "predicted").collect()}
    assert len(got) == docs.count()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(got[r["doc_id"]], r["quality"]) for r in labels.collect() if r["doc_id"] in got and got[r["doc_id"]]["held_out"]]
    assert np.mean([r["predicted"] == q for r, q in held]) >= 0.9
    good, bad = ([r["score"] for r, q in held if q == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) >= 0.9
    assert abs(np.mean([r["score"] for r, _ in held]) - np.mean([q for _, q in held])) < 0.12


def test_odd_rows_empty_tables_and_missing_labels(spark, odd_docs, no_docs):
    labels = table(spark, "labels")
    odd = labels.limit(0).unionByName(spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, 1, 0), (5, None, 0), (None, 1, 0)], labels.schema))
    for some in (labels.limit(0), odd):
        rows = quality.score_documents(odd_docs, some).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
        blank = {r["score"] for r in rows if not (r["text"] or "").split()}
        assert len(blank) == 1
    assert quality.score_documents(no_docs, labels).collect() == []


def test_only_texts_enter_a_score(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    a = quality.score_documents(docs, labels).select("doc_id", "score").collect()
    other = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string"))
    b = quality.score_documents(other, labels).select("doc_id", "score").collect()
    assert {tuple(r) for r in a} == {tuple(r) for r in b}


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6000, quality.DIM))
    y = (rng.random(6000) < 1 / (1 + np.exp(-3 * x[:, 0] - 2 * np.abs(x[:, 1]) + 1))).astype(float)
    p = quality.Network(x[:4000], y[:4000]).score(x[4000:])
    assert ((p > 0.5) == y[4000:]).mean() > 0.75
    for low in (0.2, 0.4, 0.6, 0.8):
        some = (p >= low) & (p < low + 0.2)
        assert abs(p[some].mean() - y[4000:][some].mean()) < 0.12


def test_context_sums_match_a_plain_loop():
    at, sign = quality.index_vectors()
    ids = np.array([5, 9, 5, 7, quality.BUCKETS, quality.BUCKETS, 9])
    total = np.zeros((quality.BUCKETS + 1) * quality.DIM)
    quality.add_contexts(total, ids, at, sign)
    want = np.zeros((quality.BUCKETS + 1, quality.DIM))
    for i in range(len(ids)):
        for j in range(len(ids)):
            if 0 < abs(i - j) <= quality.REACH:
                for m in range(quality.MARKS):
                    want[ids[i], at[ids[j], m]] += sign[ids[j], m]
    assert np.array_equal(total.reshape(want.shape), want)


def test_words_of_a_batch_are_looked_up_once(monkeypatch):
    texts = ["Foo's _x_ a, b.c, ABC!! ...!! x_, é, É. naïve… \x1c z \x85 q\xa0w", "tab\tend,\nend end, END", None, "", " \n ", "..., a"]
    seen = []
    monkeypatch.setattr(quality, "chunk_ids", lambda c, made=quality.chunk_ids: seen.append(c) or made(c))
    ids, at = quality.Words()(pa.array(texts))
    want = []
    for t in texts:
        want.append([])
        for before, word, after in (quality.SHAPE.fullmatch(w).groups() for w in (t or "").split()):
            mark = "^" if len(word) > 1 and word.isupper() else ""
            want[-1] += [zlib.crc32(x.encode()) % quality.BUCKETS for x in (before, word and mark + word.lower(), after) if x]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want
    assert len(seen) == len(set(seen)) and "end," not in seen


def test_context_sums_do_not_depend_on_stretches(monkeypatch):
    at, sign = quality.index_vectors()
    ids = np.random.default_rng(1).integers(0, 50, 1000).astype(np.uint16)
    whole, cut = (np.zeros((quality.BUCKETS + 1) * quality.DIM) for _ in range(2))
    quality.add_contexts(whole, ids, at, sign)
    for size in (97, 250, 999):
        monkeypatch.setattr(quality, "STRETCH", size)
        cut[:] = 0
        quality.add_contexts(cut, ids, at, sign)
        assert np.array_equal(whole, cut)
