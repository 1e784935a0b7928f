"""SimHash near-duplicates found with vantage-point trees.

Equal fingerprints are one point. A tree over a bounded sample of points routes
all of them to shards: at a node a point goes inside or outside a ball around the
vantage point, and because two points within r of each other differ by at most r
in their distance to it, an inside point within r of the boundary is also sent
outside as a visitor. So of two linked points that part at a node, one visits the
other's side, and every link shows up in some shard. A dense ball can leave a shard
with far more points than meant; beyond what a task should hold it is cut in blocks
by hash, and each pair of blocks becomes a shard of its own. Each shard is searched with a tree of its own,
pruned by the same bounds, and reports a spanning forest of its links instead of
all pairs; the forests are joined to components by rounds of hooking to the
smallest neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_facts, small_batches, written

WORDS, DISTANCE, SEED = 3, 2, 42
SAMPLE, SHARD_POINTS, LEAF = 20_000, 16_384, 256
# Points that one task searches at most: about 16 MB of them.
TASK_POINTS = 1 << 20
# Bits of up to so many shingles are added up at once.
BLOCK = 1 << 15


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint as a signed 64-bit number: bit k is set if it is set in over
    half of the XXH64 hashes of the text's word shingles, repeats included."""
    import xxhash

    w = text.encode().lower().split() if text else []
    if not w:
        return 0
    line = b" ".join(w)
    ends = [*accumulate(len(x) + 1 for x in w)]
    starts = [0, *ends]
    n = max(1, len(w) - words + 1)
    last = ends[min(words, len(w)) - 1:]
    h, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        some = [h(line[s:e - 1], seed) for s, e in zip(starts[at: at + BLOCK], last[at: at + BLOCK])]
        bits = np.unpackbits(np.array(some, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(0, dtype=np.int64)
    set_bits = (2 * votes > n).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", words: int = WORDS, seed: int = SEED, name: str = "fp") -> DataFrame:
    """Add the fingerprint of the whole text. A-Z is lower-cased; words are runs
    without ASCII white space; fewer words than a shingle are one shingle; no
    words, an empty text and null give 0."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, words, seed) for t in texts], dtype="int64")

    return docs.withColumn(name, of(F.col(text_col).cast("string")))


def away(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int16)


def choose(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """A vantage point and radius that split the points most evenly; None if they
    are all one point. The candidates are spread over the sorted points."""
    best = None
    for v in np.unique(points[np.linspace(0, len(points) - 1, 5).astype(int)]):
        d = away(points, v)
        r = int(np.median(d))
        if r == d.max():
            r -= 1
        inside = int((d <= r).sum())
        if 0 < inside < len(points):
            score = abs(2 * inside - len(points))
            if best is None or score < best[0]:
                best = score, v, r
    return best and best[1:]


def grow(sample: np.ndarray, shards: int) -> list[tuple]:
    """A routing tree with about ``shards`` leaves: node k is (vantage, radius,
    inside node, outside node), a leaf (None, shard, 0, 0)."""
    nodes: list[tuple] = []

    def build(points: np.ndarray, want: int) -> int:
        k = len(nodes)
        nodes.append(())
        cut = choose(points) if want > 1 and len(points) > 1 else None
        if cut is None:
            nodes[k] = (None, k, 0, 0)
            return k
        v, r = cut
        d = away(points, v)
        near = points[d <= r]
        share = min(want - 1, max(1, round(want * len(near) / len(points))))
        inner = build(near, share)
        outer = build(points[d > r], want - share)
        nodes[k] = (v, r, inner, outer)
        return k

    build(np.sort(sample), max(1, shards))
    return nodes


def route(nodes: list[tuple], points: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, home) for every shard a point lives in or visits."""
    out = []

    def walk(k: int, rows: np.ndarray, home: np.ndarray) -> None:
        if not len(rows):
            return
        v, r, inner, outer = nodes[k]
        if v is None:
            out.append((rows, np.full(len(rows), r), home))
            return
        d = away(points[rows], v)
        # Residents go to one side, inside ones near the boundary visit the other;
        # visitors go wherever a resident within the distance can be.
        ins = np.where(home, d <= r, d <= r + distance)
        outs = (d > r) | (d > r - distance)
        walk(inner, rows[ins], home[ins])
        walk(outer, rows[outs], home[outs] & (d[outs] > r))

    walk(0, np.arange(len(points)), np.ones(len(points), bool))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool))


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = a = up[up[a]]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def search(points: np.ndarray, home: np.ndarray, distance: int, leaf: int = LEAF) -> list[tuple[int, int]]:
    """A spanning forest of the links between residents, and between residents and
    visitors, of one shard, as pairs of positions."""
    forest, found = Forest(len(points)), []

    def compare(live: np.ndarray, guests: np.ndarray) -> None:
        both = np.concatenate([live, guests])
        step = max(1, (1 << 22) // max(1, len(both)))
        for at in range(0, len(live), step):
            some = live[at: at + step]
            near = np.bitwise_count(points[some][:, None] ^ points[both][None, :]) <= distance
            for i, j in zip(*np.nonzero(near)):
                a, b = int(some[i]), int(both[j])
                if a != b and forest.join(a, b):
                    found.append((a, b))

    stack = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while stack:
        live, guests = stack.pop()
        if not len(live):
            continue
        cut = choose(points[live]) if len(live) > leaf else None
        if cut is None:
            compare(live, guests)
            continue
        v, r = cut
        d, g = away(points[live], v), away(points[guests], v)
        near = live[(d <= r) & (d > r - distance)]
        if len(near) > 0.9 * (d <= r).sum() and len(live) <= 16 * leaf:
            compare(live, guests)  # the bounds prune nothing here
            continue
        stack.append((live[d <= r], guests[g <= r + distance]))
        stack.append((live[d > r], np.concatenate([guests[g > r - distance], near])))
    return found


def links(points: DataFrame, distance: int = DISTANCE, sample: int = SAMPLE, shard_points: int = SHARD_POINTS,
          task_points: int = TASK_POINTS) -> DataFrame:
    """Distinct fingerprints (column ``fp``) -> spanning links ``a, b``. The tree is
    fitted on at most ``sample`` points; all points are routed and searched, and no
    task searches many more than ``task_points``."""
    spark = points.sparkSession
    count = points.count()
    if count < 2:
        return spark.createDataFrame([], "a long, b long")
    some = points.orderBy(F.xxhash64("fp")).limit(sample).collect()
    nodes = grow(np.array([r["fp"] for r in some], np.int64).view(np.uint64), -(-count // shard_points))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy(np.int64)
            row, shard, home = route(nodes, fp.view(np.uint64), distance)
            yield pd.DataFrame({"shard": shard, "fp": fp[row], "home": home})

    def find(group: pd.DataFrame) -> pd.DataFrame:
        fp = group["fp"].to_numpy(np.int64)
        pairs = np.array(search(fp.view(np.uint64), group["home"].to_numpy(bool), distance), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": fp[pairs[:, 0]], "b": fp[pairs[:, 1]]})

    sent = written(points.select("fp").mapInPandas(send, "shard int, fp long, home boolean"), "routed")
    # Shards are fewer than the sample's points, so their sizes may be broadcast.
    blocks = F.when(F.col("n") > task_points, F.ceil(2 * F.col("n") / task_points)).otherwise(1)
    sizes = sent.groupBy("shard").agg(F.count("*").alias("n")).select("shard", blocks.cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), "blocks").cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = (sent.join(F.broadcast(sizes), "shard").select("shard", "fp", "home", own.alias("own"), other.alias("other"))
             .select("shard", "fp", "home", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")))
    return dealt.groupBy("shard", "low", "high").applyInPandas(find, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Links ``a, b`` -> ``node, root``, the root being the smallest node of the
    component. Each round every node's larger neighbours, then its smaller ones,
    are hooked to the smallest it knows; both steps are joins and minima, so a
    node with very many links is split like any skewed join key. Ends when the
    links are stars: no node has two smaller neighbours, or smaller and larger ones."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        known = both.groupBy("a").agg(F.count_if(F.col("b") < F.col("a")).alias("low"), F.count_if(F.col("b") > F.col("a")).alias("high"))
        if known.where("low > 1 or (low = 1 and high > 0)").limit(1).count() == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = written(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                        .where("a <> b").distinct(), "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE, seed: int = SEED,
                    id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, fp, component_id, root`` for every row, and the columns ``carry``: the
    fingerprint (signed), the smallest id among the documents reached over links of at
    most ``distance`` differing bits, itself included, and the smallest fingerprint
    among these, which names the component also where ids are null or repeated.

    Null and empty texts have fingerprint 0 and link like any other. Null ids are
    never the smallest unless there is no other. Repeated rows stay. An empty
    table gives no rows. Other columns are not read.
    """
    base = written(fingerprints(docs.select(id_col, text_col, *carry), text_col, words, seed).select(id_col, *carry, "fp"), "fingerprints")
    points = written(base.groupBy("fp").agg(F.min(id_col).alias("__least")), "points")
    root = components(links(points, distance))
    linked = root.select(F.col("node").alias("fp"), "root").unionByName(
        root.select(F.col("root").alias("fp"), "root").distinct())
    named = points.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("__least").alias("component_id"))
    of_point = written(named.join(least, "root").select("fp", "component_id", "root"), "component")
    return join_facts(base, of_point, "fp").select(id_col, *carry, "fp", "component_id", "root")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group of linked fingerprints, with all columns: of its smallest
    id the smallest content, and of rows that repeat both any one. Null ids come after
    all others. Texts are read once for the fingerprint and move once, after exact
    repeats were merged where they are."""
    marks = ("__mark", "__twin")  # two hashes name a row's id and content
    marked = docs.withColumn("__mark", F.xxhash64(id_col, text_col)).withColumn("__twin", F.xxhash64(F.lit(7), text_col, id_col))
    found = near_duplicates(marked, id_col=id_col, text_col=text_col, carry=marks, **options)
    first = F.min_by(F.struct(*marks), F.struct(F.col(id_col).isNull(), F.col(id_col), *(F.col(m) for m in marks)))
    stay = found.groupBy("root").agg(first.alias("stay")).select("stay.*")
    # An inner join: a semi-join would be moved below the merging of repeats.
    return marked.dropDuplicates([*marks]).join(stay, [*marks]).select(*docs.columns)


def hex16(fp):
    """A signed fingerprint column as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
