import numpy as np
import pytest
from pyspark.sql import functions as F

from broadsheet.llm import bitslice, nndescent

from .conftest import table

ODD = "vec_id long, embedding array<double>, label int, rank int, score string"


def odd_vectors(spark, n=120, dims=6):
    """Ties, copies, nulls, non-finite and zero vectors, another length, repeated rows."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, dims) / 4], 1, 2, "x") for i in range(n)]
    rows += [(200 + i, [0.5] * dims, None, 2, "x") for i in range(40)]
    rows += [rows[0], rows[0], (300, None, 1, 1, "x"), (301, [None] * dims, 1, 1, "x"), (302, [float("nan")] + [1.0] * (dims - 1), 1, 1, "x"),
             (303, [float("inf")] * dims, 1, 1, "x"), (304, [0.0] * dims, 1, 1, "x"), (305, [], 1, 1, "x"), (306, [1.0], 1, 1, "x"),
             (None, [1.0] * dims, 1, 1, "x")]
    return spark.createDataFrame(rows, ODD)


def brute(rows, asks, k, score, fine):
    kept = {}
    for i, v in rows:
        if i is not None and v is not None and None not in v and np.isfinite(v).all() and fine(v):
            kept[i] = v
    out = set()
    for q in kept:
        if asks(q):
            near = sorted(((-score(kept[q], v), i) for i, v in kept.items() if i != q and len(v) == len(kept[q])))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(near)}
    return out


def whole(a, b):
    return sum(int(np.floor(256 * x)) * int(np.floor(256 * y)) for x, y in zip(a, b))


@pytest.mark.parametrize("block,batch", [(32, 4), (4096, 256)])
def test_bit_slices_match_brute_force_on_odd_vectors(spark, block, batch):
    df = odd_vectors(spark)
    got = bitslice.top_k(df, F.col("vec_id") % 5 == 0, 5, block_rows=block, batch_queries=batch).collect()
    want = brute([(r["vec_id"], r["embedding"]) for r in df.collect()], lambda q: q % 5 == 0, 5, whole, len)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert bitslice.top_k(df.limit(0), F.col("vec_id") % 5 == 0).collect() == []


def test_large_components_and_long_vectors_are_exact(spark):
    rng = np.random.default_rng(8)
    rows = [(k, [float(x) for x in rng.normal(size=1024)]) for k in range(90)]
    rows += [(100 + k, [2e6, 1.0, -k / 7]) for k in range(30)] + [(140, [-1e300, 0.5, 1.0]), (141, [0.0, 2.0 ** 40, 3.0]), (142, [-3e40, 1e-300, 9.0])]
    rows += [(200 + k, [1e6 * (1 if k % 2 else -1)] * 600) for k in range(6)] + [(210, [0.25] * 600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = lambda v: [int(np.floor(x * 256)) if abs(x) < 1e300 else int(x) * 256 for x in v]
    whole = [(i, exact(v)) for i, v in rows]
    want = set()
    for q, a in whole:
        if q % 5 == 0 and q < 140 or q == 210:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if len(a) == len(b) and i != q)
            want |= {(q, n, i, -s) for n, (s, i) in enumerate(scores[:3], 1)}
    asks = (F.col("vec_id") % 5 == 0) & (F.col("vec_id") < 140) | (F.col("vec_id") == 210)
    assert {tuple(r) for r in bitslice.top_k(df, asks, 3).collect()} == want
    with pytest.raises(Exception, match="CAST_OVERFLOW|CAST_INVALID_INPUT"):
        bitslice.top_k(df, F.col("vec_id") == 200, 3).collect()


def test_bit_sliced_sum_is_the_inner_product():
    rng = np.random.default_rng(1)
    values, query = rng.integers(-300, 300, (200, 7)), np.array([0, 5, -9, 1, -1, 255, -256])
    low, bits, slices = bitslice.slices_of(values)
    starts = np.concatenate([[0], np.cumsum(bits)])
    total = bitslice.weighted_sum(slices, bits, starts, query)
    sums = np.zeros(200, np.int64)
    for j, bitmap in enumerate(total):
        sums[bitslice.positions(bitmap)[bitslice.positions(bitmap) < 200]] += 1 << j
    exact = values @ query
    assert (sums - exact == (sums - exact)[0]).all()


def test_nn_descent_finds_nearly_all_neighbours(spark):
    df = table(spark, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect()]
    got = nndescent.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()
    want = brute(rows, lambda q: q % 20 == 0, 20, lambda a, b: float(np.dot(np.array(a, float), np.array(b, float))), any)
    assert len(got) == len(want)
    assert len({(r["query_id"], r["vec_id"]) for r in got} & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)
    exact = {(q, i): s for q, _, i, s in want}
    assert all(abs(exact.get((r["query_id"], r["vec_id"]), r["score"]) - r["score"]) < 1e-12 for r in got)


def test_nn_descent_on_odd_vectors(spark):
    df = odd_vectors(spark)
    got = nndescent.nearest(df, F.col("vec_id") % 5 == 0, 20).collect()
    kept = [(r["vec_id"], r["embedding"]) for r in df.collect() if r["embedding"] is not None and len(r["embedding"]) == 6]
    want = brute(kept, lambda q: q % 5 == 0, 20, lambda a, b: float(np.dot(a, b)), any)
    assert len(got) == len(want)
    assert len({(r["query_id"], r["vec_id"]) for r in got} & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"], r["rank"]))
    assert all([x[2] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in by.values())
    assert nndescent.nearest(df.limit(0), F.col("vec_id") % 5 == 0).collect() == []
    few = nndescent.nearest(df.where("vec_id < 4"), F.col("vec_id") == 0, 20).collect()
    assert [r["rank"] for r in few] == [1, 2, 3]


def test_nn_descent_reaches_outliers_and_other_lengths(spark):
    # Two clusters fill few cells; outliers are alone in theirs.
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(2, 8))
    x = np.concatenate([middle[np.arange(2100) % 2] + 0.1 * rng.normal(size=(2100, 8)), 2 * rng.normal(size=(12, 8))])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(5000 + i, [float(c) for c in rng.normal(size=3)]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asks = lambda q: q >= 2100 or q % 100 == 0
    got = nndescent.nearest(df, (F.col("vec_id") >= 2100) | (F.col("vec_id") % 100 == 0), 20).collect()
    want = brute(rows, asks, 20, lambda a, b: float(np.dot(a, b)), any)
    assert sorted((r["query_id"], r["rank"]) for r in got) == sorted((q, r) for q, r, _, _ in want)
    found = {(r["query_id"], r["vec_id"]) for r in got}
    for part in (lambda q: q < 2100, lambda q: 2100 <= q < 5000, lambda q: q >= 5000):
        pairs = {(q, i) for q, _, i, _ in want if part(q)}
        assert len(found & pairs) >= 0.9 * len(pairs)
