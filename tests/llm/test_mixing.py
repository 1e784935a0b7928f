import itertools
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from broadsheet.llm import mixing

from .conftest import table


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def goals(sizes):
    """Targets by repeated sharing, as the contract says it."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    fixed, left = {}, float(sum(sizes.values()))
    while True:
        live = [s for s in names if s not in fixed]
        share = {s: left * w[s] / sum(w[x] for x in live) for s in live}
        over = [s for s in live if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        for s in over:
            fixed[s] = 3.0 * sizes[s]
            left -= fixed[s]


def check(rows, docs):
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += words(t)
    want = goals(sizes)
    took = defaultdict(int)
    for r in rows:
        assert 0 <= r["copies"] <= 3 and (r["words"] or r["copies"] == 0)
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        took[r["source"]] += r["copies"] * r["words"]
    assert len(rows) == len(docs)
    return {s: (took[s], want[s]) for s in sizes}


def mixed(docs, **more):
    sized = docs.withColumn("words", F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)))
    return mixing.mix(sized, size_col="words", **more)


def test_every_source_comes_near_its_target(spark):
    docs = table(spark, "documents")
    rows = mixed(docs).collect()
    for took, want in check(rows, [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]).values():
        assert abs(took - want) <= 0.02 * want + 3, (took, want)
    again = mixed(docs.repartition(5)).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in rows) == sorted((r["doc_id"], r["copies"]) for r in again)
    assert sorted((r["doc_id"], r["copies"]) for r in rows) != sorted((r["doc_id"], r["copies"]) for r in mixed(docs, seed=5).collect())


def test_odd_rows_and_empty_table(spark, odd_docs, no_docs):
    check(mixed(odd_docs).collect(), [(r["doc_id"], r["text"], r["source"]) for r in odd_docs.collect()])
    assert mixed(no_docs).collect() == []


def test_mixed_documents_repeat_rows_and_keep_columns(spark, odd_docs):
    docs = table(spark, "documents")
    copies = {r["doc_id"]: r["copies"] for r in mixed(docs).collect()}
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    assert {r["doc_id"]: r["n"] for r in got.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {k: v for k, v in copies.items() if v}
    assert mixing.mixed_documents(odd_docs).columns == odd_docs.columns


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 3)), min_size=1, max_size=4, unique_by=lambda x: x[0]), st.integers(0, 60))
def test_fit_is_as_near_as_its_share_allows(items, budget):
    lengths, counts = [a for a, _ in items], [b for _, b in items]
    take = mixing.fit(lengths, counts, budget)
    assert all(0 <= t <= c for t, c in zip(take, counts))
    got = sum(a * t for a, t in zip(lengths, take))
    whole = sum(a * c for a, c in zip(lengths, counts))
    base = [c * min(budget, whole) // whole for c in counts]
    ways = itertools.product(*[range(b, c + 1) for b, c in zip(base, counts)])
    assert abs(got - budget) == min(abs(sum(a * t for a, t in zip(lengths, w)) - budget) for w in ways) or budget > whole


@pytest.mark.parametrize("budget", [0, 1, 999_999, 123_457_777, 10 ** 12])
def test_fit_meets_large_budgets_exactly(budget):
    lengths, counts = list(range(3, 4000, 7)), [50_000] * 571
    whole = sum(a * c for a, c in zip(lengths, counts))
    take = mixing.fit(lengths, counts, budget)
    assert abs(sum(a * t for a, t in zip(lengths, take)) - min(budget, whole)) <= (2 if budget < 3 else 0)
