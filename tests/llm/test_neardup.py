from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from broadsheet.llm import neardup

from .conftest import table


def slow_fingerprint(text):
    w = (text or "").encode().translate(bytes([c + 32 if 65 <= c <= 90 else c for c in range(256)])).split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[k: k + 3]), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    fps = sorted({fp for _, fp in rows})
    up = {fp: fp for fp in fps}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    a = np.array(fps, np.uint64)
    for i, fp in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= 2):
            up[find(fp)] = find(fps[i + 1 + int(j)])
    least = {}
    for i, fp in rows:
        if i is not None:
            least[find(fp)] = min(i, least.get(find(fp), i))
    return Counter((i, f"{fp:016x}", least.get(find(fp))) for i, fp in rows)


def found(docs):
    out = neardup.near_duplicates(docs).select("doc_id", neardup.hex16("fp").alias("fp"), "component_id").collect()
    return Counter(tuple(r) for r in out)


def test_documents_match_brute_force(spark):
    docs = table(spark, "documents")
    assert found(docs) == slow_components([(r["doc_id"], slow_fingerprint(r["text"])) for r in docs.collect()])


def test_odd_rows_and_empty_table(spark, odd_docs, no_docs):
    assert found(odd_docs) == slow_components([(r["doc_id"], slow_fingerprint(r["text"])) for r in odd_docs.collect()])
    assert not found(no_docs)


def test_dense_and_sparse_fingerprints_in_many_shards(spark):
    """Chains, balls around a centre and random points: every link is found."""
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(0, 2 ** 63, 3000)]
    for centre in fps[:6]:
        for _ in range(150):
            x = centre
            for b in rng.integers(0, 64, int(rng.integers(1, 5))):
                x ^= 1 << int(b)
            fps.append(x & (2 ** 64 - 1))
    at = fps[7]
    for step in range(30):
        at ^= 3 << 2 * step
        fps.append(at)
    fps = list(dict.fromkeys(fps))
    points = spark.createDataFrame([(int(np.uint64(x).view(np.int64)) if hasattr(np.uint64(x), "view") else x,) for x in fps], "fp long")
    links = neardup.links(points, shard_points=200, sample=500)
    roots = {r["node"]: r["root"] for r in neardup.components(links).collect()}
    signed = {int(np.array(x, np.uint64).view(np.int64)): x for x in fps}
    group = {}
    for s, x in signed.items():
        group.setdefault(roots.get(s, s), set()).add(x)
    want = slow_components([(k, x) for k, x in enumerate(fps)])
    slow = {}
    for k, x, c in want:
        slow.setdefault(c, set()).add(int(x, 16))
    assert sorted(map(sorted, group.values())) == sorted(map(sorted, slow.values()))


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(0, k) for k in range(1, 50)]
    both = spark.createDataFrame(chain + star + [(300, 200), (200, 300), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in neardup.components(both).collect()}
    assert got == {**{k: 100 for k in range(101, 161)}, **{k: 0 for k in range(1, 50)}, 300: 200}
    assert neardup.components(both.limit(0)).collect() == []


def test_fingerprint_is_spark_xxhash64(spark):
    row = spark.createDataFrame([("one two three",)], "t string").select(F.xxhash64("t").alias("h")).first()
    assert neardup.fingerprint("One  two\tTHREE") == row["h"]


def test_oversized_shards_are_cut_in_block_pairs(spark):
    """A dense ball that no tree splits well, far over the shard size: every link is found."""
    rng = np.random.default_rng(5)
    centre = int(rng.integers(1 << 62))
    ball = {centre ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 62, (900, 3))}
    points = sorted(ball | {int(x) for x in rng.integers(0, 1 << 62, 300)})
    df = spark.createDataFrame([(p,) for p in points], "fp long")
    edges = neardup.links(df, shard_points=64, task_points=128).collect()
    sizes = neardup.Forest(len(points))
    at = {p: k for k, p in enumerate(points)}
    for e in edges:
        assert bin(e.a ^ e.b).count("1") <= 2
        sizes.join(at[e.a], at[e.b])
    want = neardup.Forest(len(points))
    for i, p in enumerate(points):
        for j in range(i):
            if bin(p ^ points[j]).count("1") <= 2:
                want.join(i, j)
    assert [sizes.find(k) for k in range(len(points))] == [want.find(k) for k in range(len(points))]
