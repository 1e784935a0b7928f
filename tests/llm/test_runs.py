"""Periodic runs against a plain search."""

import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from broadsheet.llm import runs
from broadsheet.llm.queries import op13_maximal_pair_runs

from .conftest import DATA, table


def plain_runs(words, least=24, times=3):
    found = []
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(least, times * q) and not any(
                    all(words[i + k] == words[i + k + r] for k in range(n - r)) for r in range(1, q)):
                found.append((i, n, q))
            i = j + 1
    return sorted(found)


def plain_collapsed(words, found):
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.text("abc", min_size=1, max_size=6), st.integers(1, 12)), max_size=4), max_size=3),
       st.sampled_from([(24, 3), (6, 3), (4, 2), (1, 2), (9, 4)]))
def test_core_equals_plain_search(parts, rule):
    texts = [[c.encode() for base, n in p for c in base * n] for p in parts]
    assert runs.runs_of_texts(texts, *rule) == [plain_runs(t, *rule) for t in texts]


def test_long_periodic_texts():
    assert runs.runs_of_texts([[b"w"] * 30_000, [b"a", b"b", b"c"] * 9_000 + [b"a"]]) == [[(0, 30_000, 1)], [(0, 27_001, 3)]]


def test_many_repeats_far_apart_are_not_paired():
    words = [w for i in range(3000) for w in [*(b"p%d" % j for j in range(17)), b"x%d" % i]]
    assert runs.runs_of_texts([words]) == [[]]


def test_period_is_the_smallest_and_ends_are_exact():
    words = [b"z", *[b"a", b"b"] * 15, b"a", b"q"]
    assert runs.runs_of_texts([words]) == [[(1, 31, 2)]]


def test_operator_over_odd_documents(spark, odd_docs, no_docs):
    got = {(r.doc_id, r.collapsed[:20]): [tuple(x) for x in r.runs] for r in runs.find_runs(odd_docs).collect()}
    assert got[(5, "word")] == [(0, 30_000, 1)]
    assert got[(2, "")] == got[(3, "")] == got[(7, "")] == got[(None, "")] == []
    assert len(runs.find_runs(odd_docs).collect()) == odd_docs.count()
    assert runs.find_runs(no_docs).collect() == []
    assert runs.find_runs(runs.planted(no_docs)).collect() == []


def test_strongest_breaks_ties(spark):
    rows = [([(5, 30, 3), (1, 60, 6), (1, 20, 2)],), ([],), ([(0, 7, 2), (3, 10, 3)],)]
    df = spark.createDataFrame(rows, f"runs {runs.RUN}").select(runs.strongest("runs").alias("b"))
    assert [r.b and tuple(r.b) for r in df.collect()] == [(1, 20, 2), None, (0, 7, 2)]


def test_query_equals_plain_search(spark):
    import hashlib
    got = {r.doc_id: r for r in op13_maximal_pair_runs(spark, DATA).collect()}
    rng = random.Random(1)
    docs = table(spark, "documents").collect()
    assert len(got) == len(docs)
    planted = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 10 == 0]
    for d in [*planted, *rng.sample(docs, 30)]:
        words = [w.decode() for w in (d.text or "").encode().split()]
        n, h = len(words), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 3000:
            continue
        found = plain_runs(words)
        r = got[d.doc_id]
        assert r.n_runs == len(found)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapsed(words, found).encode()).hexdigest()
        if found:
            s, m, q = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, m, q, 1000 * m // q)
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4
