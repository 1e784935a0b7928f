"""Approximate nearest neighbours: NN-descent graph and greedy search.

Equal vectors are one node; vectors of each length are searched by themselves.
Nodes start with the best neighbours of small random cells (signs of random
projections, split further where a cell is crowded) and of parts dealt by hash, so
that a node alone in its cells has neighbours as well. Then,
round by round, the graph is joined with itself: each node brings its neighbours
and a sample of those that name it together, compares them pairwise, and proposes
pairs that beat what either end holds; every node keeps its best. Queries walk
the graph greedily: from the query's own node and some drawn by hash, the best unexpanded nodes' lists
are joined in, scored, and the best kept, hop by hop, until all that is kept is
expanded. Rounds end when the lists hardly change, and the number kept grows with the
logarithm of the table. Both work on vectors rounded to one byte a component with a scale of their own; the nodes that the
search keeps are scored again exactly, in double precision, on the original
vectors.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written

DEGREE, REVERSE = 32, 24
CELLS, CELL = 3, 128
DEALS, ENTRIES = 2, 16
PROPOSE = 6
# A round that changes a smaller share of the lists is the last.
CHANGED = 0.05
# The beam of a table of 2,048 nodes, and what each doubling adds; parts of it expanded in a hop.
BEAM, BEAM_STEP, HOPS = 128, 64, 4
SAMPLE = 4096
# Queries that meet at one list together.
VISITS = 256


def usable(vector: Column) -> Column:
    """Neither null nor zero, no null, NaN or infinite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def rounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, dims, v) -> v as bytes of 8-bit integers, and their scale."""
    for batch in batches:
        code, scale = [], []
        for v in batch["v"]:
            v = np.asarray(v, float)
            top = np.abs(v).max()
            code.append(np.rint(v / top * 127).astype(np.int8).tobytes())
            scale.append(top / 127)
        yield pd.DataFrame({"node": batch["node"], "dims": batch["dims"], "code": code, "scale": np.array(scale, float)})


def decoded(code: pa.Array, scale: pa.Array, dims: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(code.to_pylist()), np.int8).reshape(-1, dims).astype(np.float32)
    return raw * scale.to_numpy(zero_copy_only=False).astype(np.float32)[:, None]


def cells(nodes: DataFrame, count: int, dims: int, seed: int) -> DataFrame:
    """``node, code, scale, cell``: cells of about CELL nodes by the signs of random
    projections, cut at the medians of a bounded sample. A crowded cell is dealt
    to parts by hash, so that no part grows with it."""
    depth = max(0, math.ceil(math.log2(max(1, count / CELL))))
    rng = np.random.default_rng(seed)
    axes = rng.normal(size=(dims, depth))
    some = nodes.orderBy(F.xxhash64("node", F.lit(seed))).limit(SAMPLE).select("code", "scale").collect()
    known = np.array([np.frombuffer(r["code"], np.int8) * r["scale"] for r in some], float).reshape(-1, dims)
    middle = np.median(known @ axes, axis=0) if len(known) else np.zeros(depth)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = decoded(batch.column(1), batch.column(2), dims)
            cell = ((x @ axes > middle) @ (1 << np.arange(depth, dtype=np.int64))).astype(np.int64) if depth else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["node", "code", "scale", "cell"])

    dealt = nodes.select("node", "code", "scale").mapInArrow(assign, "node long, code binary, scale double, cell long")
    crowd = dealt.groupBy("cell").agg(F.ceil(F.count("*") / (2 * CELL)).alias("parts"))
    return dealt.join(crowd, "cell").withColumn("part", F.pmod(F.xxhash64("node", F.lit(seed)), "parts"))


def deals(nodes: DataFrame, count: int, seed: int) -> DataFrame:
    """``node, code, scale, cell, part``: parts of about CELL nodes dealt by hash."""
    part = F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(max(1, count // CELL)))
    return nodes.select("node", "code", "scale", F.lit(0).cast("long").alias("cell"), part.alias("part"))


def best_of(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k largest entries."""
    k = min(k, score.shape[1])
    at = np.argpartition(-score, k - 1, axis=1)[:, :k] if k else np.zeros((len(score), 0), int)
    return np.repeat(np.arange(len(score)), k), at.ravel()


def keep_best(edges: DataFrame, degree: int) -> DataFrame:
    """``u, w, s, fresh`` -> the best of each u; an edge that was there is not fresh."""
    best = Window.partitionBy("u").orderBy(F.desc("s"), "w")
    return (edges.repartition("u").groupBy("u", "w").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
            .withColumn("r", F.row_number().over(best)).where(F.col("r") <= degree).drop("r"))


def both_ways(graph: DataFrame, reverse: int, seed: int) -> DataFrame:
    """``v, member, fresh``: each node's neighbours, and at most ``reverse`` of the
    nodes that name it, fresh ones first, drawn by hash."""
    some = Window.partitionBy("w").orderBy(F.desc("fresh"), F.xxhash64("u", "w", F.lit(seed)))
    back = graph.withColumn("r", F.row_number().over(some)).where(F.col("r") <= reverse)
    return (graph.select(F.col("u").alias("v"), F.col("w").alias("member"), "fresh")
            .unionByName(back.select(F.col("w").alias("v"), F.col("u").alias("member"), "fresh"))
            .repartition("v").groupBy("v", "member").agg(F.max("fresh").alias("fresh")))


def beam_of(count: int) -> int:
    """How many nodes a walk keeps in a graph of ``count`` nodes."""
    return BEAM + round(BEAM_STEP * max(0.0, math.log2(max(1, count) / 2048)))


def build_graph(nodes: DataFrame, count: int, dims: int, degree: int = DEGREE, reverse: int = REVERSE) -> DataFrame:
    """``node, code, scale`` (``count`` rows) -> ``u, w, s``: the neighbour graph. A
    list only ever changes for a better one, so the rounds end."""

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        x = decoded(pa.array(group["code"]), pa.array(group["scale"]), dims)
        node, s = group["node"].to_numpy(np.int64), x @ x.T
        np.fill_diagonal(s, -np.inf)
        a, b = best_of(s, min(degree, len(node) - 1))
        return pd.DataFrame({"u": node[a], "w": node[b], "s": s[a, b].astype(np.float32), "fresh": 1})

    edge = "u long, w long, s float, fresh int"
    first = None
    starts = [cells(nodes, count, dims, t + 1) for t in range(CELLS)] + [deals(nodes, count, CELLS + t + 1) for t in range(DEALS)]
    for start in starts:
        got = start.select("cell", "part", "node", "code", "scale").groupBy("cell", "part").applyInPandas(pairs, edge)
        first = got if first is None else first.unionByName(got)
    graph = written(keep_best(first, degree), "graph")

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten()
            member, fresh, floor, code, scale = (flat.field(k) for k in range(5))
            member, fresh = member.to_numpy(zero_copy_only=False), fresh.to_numpy(zero_copy_only=False)
            floor, x = floor.to_numpy(zero_copy_only=False), decoded(code, scale, dims)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
            us, ws, ss = [], [], []
            for at, end in zip([0, *ends[:-1]], ends):
                y, f, m = x[at:end], fresh[at:end], member[at:end]
                s = y @ y.T
                s[(f[:, None] | f[None, :]) == 0] = -np.inf
                np.fill_diagonal(s, -np.inf)
                s[s <= floor[at:end, None]] = -np.inf
                a, b = best_of(s, PROPOSE)
                fine = s[a, b] > -np.inf
                us.append(m[a[fine]])
                ws.append(m[b[fine]])
                ss.append(s[a, b][fine])
            u = np.concatenate(us) if us else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(u, pa.int64()), pa.array(np.concatenate(ws) if us else u, pa.int64()),
                 pa.array(np.concatenate(ss) if us else u, pa.float32()), pa.array(np.ones(len(u)), pa.int32())], ["u", "w", "s", "fresh"])

    for round_ in itertools.count():
        floor = graph.groupBy("u").agg(F.when(F.count("*") >= degree, F.min("s")).otherwise(F.lit(-3e38)).cast("float").alias("floor"))
        known = nodes.join(floor, nodes["node"] == floor["u"]).select(F.col("node").alias("member"), "floor", "code", "scale")
        # Lists without a fresh member have nothing new to compare: no vectors for them.
        together = both_ways(graph, reverse, round_).withColumn("news", F.max("fresh").over(Window.partitionBy("v"))).where("news = 1").drop("news")
        near = together.join(known, "member")
        lists = near.groupBy("v").agg(F.collect_list(F.struct("member", "fresh", "floor", "code", "scale")).alias("near")).select("near")
        old = graph.withColumn("fresh", F.lit(0))
        # A node that few name, as an outlier, is offered to those it names.
        turned = graph.select(F.col("w").alias("u"), F.col("u").alias("w"), "s", F.lit(1).alias("fresh"))
        graph = written(keep_best(old.unionByName(turned).unionByName(lists.mapInArrow(propose, edge)), degree), "graph")
        if graph.where("fresh = 1").count() <= CHANGED * degree * count:
            return graph.select("u", "w", "s", F.lit(0).alias("fresh"))


def adjacency(graph: DataFrame, nodes: DataFrame, count: int, reverse: int) -> DataFrame:
    """``node, members, codes, scales``: one row a node, its list with the members' codes
    beside it, each as one binary. Parts dealt by hash make every node a member of some
    lists, however few name it."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            member, code, scale = lists.flatten().flatten()
            member, scale, code = member.to_numpy(zero_copy_only=False), scale.to_numpy(zero_copy_only=False).astype(np.float32), code.to_pylist()
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
            spans = list(zip([0, *ends[:-1]], ends))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([member[i:j].tobytes() for i, j in spans], pa.binary()), pa.array([b"".join(code[i:j]) for i, j in spans], pa.binary()),
                 pa.array([scale[i:j].tobytes() for i, j in spans], pa.binary())], ["node", "members", "codes", "scales"])

    part = F.pmod(F.xxhash64("node", F.lit(73)), F.lit(max(1, count // ENTRIES))).alias("part")
    dealt = nodes.select("node", part)
    drawn = dealt.join(dealt.select(F.col("node").alias("member"), "part"), "part").where("node <> member").select("node", "member")
    # A member that is drawn and linked is scored twice and kept once.
    pairs = both_ways(graph, reverse, 99).select(F.col("v").alias("node"), "member").unionByName(drawn)
    lists = pairs.join(nodes.select(F.col("node").alias("member"), "code", "scale"), "member").groupBy("node").agg(
        F.collect_list(F.struct("member", "code", "scale")).alias("near"))
    return written(lists.mapInArrow(packed, "node long, members binary, codes binary, scales binary"), "adjacent")


def walk(graph: DataFrame, nodes: DataFrame, asked: DataFrame, count: int, dims: int, reverse: int = REVERSE,
         beam: int = BEAM) -> DataFrame:
    """``q`` (the query's node) -> ``q, node``: the beam when all of it is expanded. Each
    walk starts at the query's own node and about ENTRIES others, drawn by hash. The walks
    that expand a node in one hop meet at its list, VISITS at a time, and only what beats
    the worst of a full beam leaves the task. What falls out of a beam is worse than all of
    it and never returns, so the hops end."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["q", "node", "s"])

        for batch in batches:
            members, codes, scales, asks = batch.columns
            q, floor, code, scale = asks.flatten().flatten()
            q, floor, code = q.to_numpy(zero_copy_only=False), floor.to_numpy(zero_copy_only=False), code.to_pylist()
            scale = scale.to_numpy(zero_copy_only=False).astype(np.float32)
            ends = np.cumsum(asks.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
            found, rows = [], 0
            for k, (at, end) in enumerate(zip([0, *ends[:-1]], ends)):
                y = np.frombuffer(b"".join(code[at:end]), np.int8).reshape(-1, dims).astype(np.float32)
                x = np.frombuffer(codes[k].as_py(), np.int8).reshape(-1, dims).astype(np.float32)
                s = (y @ x.T) * scale[at:end, None] * np.frombuffer(scales[k].as_py(), np.float32)
                i, j = np.nonzero(s > floor[at:end, None])
                found.append((q[at:end][i], np.frombuffer(members[k].as_py(), np.int64)[j], s[i, j]))
                rows += len(i)
                if rows > 1 << 18:
                    yield table(found)
                    found, rows = [], 0
            if found:
                yield table(found)

    by_score = Window.partitionBy("q").orderBy(F.desc("s"), "node")
    whole, so_far = Window.partitionBy("q"), by_score.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def cut(state: DataFrame) -> DataFrame:
        """The best of each query; ``front``: whom the next hop expands (few until the
        beam is full); ``floor``: what a newcomer must beat."""
        kept = state.withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= beam)
        kept = kept.withColumn("full", F.count("*").over(whole) >= beam).withColumn("turn", F.sum(1 - F.col("seen")).over(so_far))
        width = F.when(F.col("full"), max(1, beam // HOPS)).otherwise(max(1, beam // (4 * HOPS)))
        floor = F.when(F.col("full"), F.min("s").over(whole)).otherwise(F.lit(-3e38)).cast("float")
        return written(kept.select("q", "node", "s", "seen", floor.alias("floor"), ((F.col("seen") == 0) & (F.col("turn") <= width)).alias("front")), "beam")

    def met(front: DataFrame) -> DataFrame:
        """``q, node, floor`` -> each node's list with the queries at it."""
        crowd = front.groupBy("node").agg(F.ceil(F.count("*") / VISITS).alias("parts")).where("parts > 1")
        front = front.join(crowd, "node", "left").withColumn("part", F.pmod(F.xxhash64("q"), F.coalesce("parts", F.lit(1))))
        asks = front.join(mine, "q").groupBy("node", "part").agg(F.collect_list(F.struct("q", "floor", "qcode", "qscale")).alias("asks"))
        return asks.join(links, "node").select("members", "codes", "scales", "asks")

    links = adjacency(graph, nodes, count, reverse)
    mine = written(asked.join(nodes, asked["q"] == nodes["node"]).select("q", F.col("code").alias("qcode"), F.col("scale").alias("qscale")), "queries")
    parts = F.lit(max(1, count // ENTRIES))
    drawn = (asked.select("q", F.pmod(F.xxhash64("q", F.lit(71)), parts).alias("part"))
             .join(nodes.select("node", F.pmod(F.xxhash64("node", F.lit(72)), parts).alias("part")), "part")
             .select("q", "node", F.lit(-3e38).cast("float").alias("floor")))
    state = cut(asked.select("q", F.col("q").alias("node"), F.lit(3e38).cast("float").alias("s"), F.lit(0).alias("seen")))
    for hop in itertools.count():
        front = state.where("front").select("q", "node", "floor")
        scored = met(front if hop else front.unionByName(drawn)).mapInArrow(score, "q long, node long, s float").withColumn("seen", F.lit(0))
        spent = state.select("q", "node", "s", F.greatest("seen", F.col("front").cast("int")).alias("seen"))
        state = cut(spent.unionByName(scored).repartition("q").groupBy("q", "node").agg(F.max("s").alias("s"), F.max("seen").alias("seen")))
        if not state.where("front").limit(1).count():
            return state.select("q", "node")


def compare(nodes: DataFrame, asked: DataFrame, beam: int) -> DataFrame:
    """``dims, node, code, scale`` and ``dims, q`` -> ``dims, q, node``: of each length,
    every query with all nodes, for lengths of few nodes."""

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        x = decoded(pa.array(group["code"]), pa.array(group["scale"]), int(group["dims"].iloc[0]))
        node, rows = group["node"].to_numpy(np.int64), np.flatnonzero(group["asks"])
        a, b = best_of(x[rows] @ x.T, beam)
        return pd.DataFrame({"dims": group["dims"].iloc[0], "q": node[rows[a]], "node": node[b]})

    marked = nodes.join(asked.select("dims", F.col("q").alias("node"), F.lit(True).alias("asks")), ["dims", "node"], "left")
    marked = marked.select("dims", "node", "code", "scale", F.coalesce("asks", F.lit(False)).alias("asks"))
    return marked.groupBy("dims").applyInPandas(pairs, "dims int, q long, node long")


def nearest(vectors: DataFrame, query: Column, k: int = 20, degree: int = DEGREE, reverse: int = REVERSE,
            beam: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row where ``query`` holds, the k
    nearest rows found by inner product, ties to the smaller id. A walk keeps ``beam``
    nodes (None: by the number of nodes), at least k + 1.

    Null and zero vectors and vectors with null or non-finite components take no
    part, nor do rows without an id; vectors of another length are no candidates.
    Rows with the query's id are its own; a repeated row counts once; fewer
    candidates than k: all of them. An empty table gives no rows.
    Other columns are not read.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    v = F.col(vector_col)
    rows = written(vectors.where(F.col(id_col).isNotNull() & usable(v)).select(
        F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("dims"), query.alias("asks")), "vectors")
    result = "query_id long, rank int, vec_id long, score double"
    distinct = written(rows.groupBy("dims", "v").agg(F.min("vec_id").alias("node")), "nodes")
    nodes = written(distinct.select("node", "dims", "v").mapInPandas(rounded, "node long, dims int, code binary, scale double"), "codes")
    sizes = nodes.groupBy("dims").agg(F.count("*").alias("n"))
    large = {r["dims"]: r["n"] for r in sizes.where(F.col("n") > 2 * CELL).orderBy("dims").collect()}
    if not large and not sizes.limit(1).count():
        return spark.createDataFrame([], result)
    # Of equal vectors only the k + 1 smallest ids can be among a query's k nearest.
    named = rows.join(distinct, ["dims", "v"]).select("dims", "node", "vec_id", "asks")
    by_id = Window.partitionBy("dims", "node").orderBy("vec_id")
    named = written(named.dropDuplicates(["dims", "node", "vec_id"]), "members")
    members = named.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1).select("dims", "node", "vec_id")
    asked = named.where("asks").select("dims", F.col("node").alias("q"), F.col("vec_id").alias("query_id"))
    queries = written(asked.select("dims", "q").distinct(), "asked")
    few = ~F.col("dims").isin(list(large))
    beam_ = compare(nodes.where(few), queries.where(few), max(beam or BEAM, k + 1))
    for dims, count in large.items():
        mine, some = nodes.where(F.col("dims") == dims).drop("dims"), queries.where(F.col("dims") == dims).drop("dims")
        graph = build_graph(mine, count, dims, degree, reverse)
        found = walk(graph, mine, some, count, dims, reverse, max(beam or beam_of(count), k + 1))
        beam_ = beam_.unionByName(found.withColumn("dims", F.lit(dims)))

    @F.pandas_udf("double")
    def exact(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(np.dot(np.asarray(x, float), np.asarray(y, float))) for x, y in zip(a, b)], dtype=float)

    full = distinct.select("dims", "node", "v")
    scored = (beam_.join(full, ["dims", "node"]).join(full.select("dims", F.col("node").alias("q"), F.col("v").alias("qv")), ["dims", "q"])
              .select("dims", "q", "node", exact("v", "qv").alias("score")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # Every node has at least one row, so the k + 1 best scores hold the answer.
    by_score = Window.partitionBy("dims", "q").orderBy(F.desc("score"))
    scored = scored.withColumn("r", F.dense_rank().over(by_score)).where(F.col("r") <= k + 1).drop("r")
    return (asked.join(scored, ["dims", "q"]).join(members, ["dims", "node"]).where("vec_id <> query_id")
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
