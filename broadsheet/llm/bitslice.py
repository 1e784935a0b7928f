"""Exact top-k by integer inner product over a bit-sliced index.

Vectors are quantised to integers and dealt to blocks. A block stores, for every
dimension, the bits of its values as bitmaps over its rows (slices). A query adds
the slices, weighted by its own bits, with carry-save bitmap arithmetic: the sum
is again a set of slices. From the most significant slice downward rows that have
the bit are taken while they fit into the k, else the others are put aside; when
few rows are left, or all that are left tie, these boundary rows are resolved
exactly by their integer scores and ids. Slices have no width, so components may
be of any size; scores are added up as longs where they must fit, and else as
Python's own integers. Batches of queries go to the blocks, where a task holds one
block and streams the batches past it; the k best of each block are merged by rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_rows, small_batches, written

# Rows of a block, of longer vectors fewer (components of a block); queries of a
# batch, and batches that one copy of a block answers.
BLOCK_ROWS, BLOCK_CELLS, BATCH_QUERIES, BATCHES = 32_768, 2 ** 21, 256, 64
SCALE = 256.0
LONG = 2 ** 63


def floored(vector: Column, scale: float = SCALE) -> Column:
    """floor(scale * x) of each component as double, which holds it exactly; a
    component too large for that stays as it is."""
    def one(x: Column) -> Column:
        y = x.cast("double") * F.lit(scale)
        return F.when(F.abs(y) < 2.0 ** 53, F.floor(y).cast("double")).when(F.abs(y) < F.lit(float("inf")), y).otherwise(x.cast("double"))
    return F.transform(vector, one)


def quantised(x: np.ndarray, scale: float = SCALE) -> np.ndarray:
    """floor(scale * x) as longs, or as Python integers if one is beyond 2^53."""
    if not x.size or np.abs(x).max() * scale < 2.0 ** 53:
        return np.floor(x * scale).astype(np.int64)
    whole = [math.floor(v * scale) if math.isfinite(v * scale) else math.floor(v) * int(scale) for v in x.ravel().tolist()]
    return np.array(whole, object).reshape(x.shape)


def most(values: np.ndarray) -> int:
    return max((abs(int(v)) for v in (values.min(), values.max())), default=0) if values.size else 0


def usable(vector: Column) -> Column:
    """No null, NaN or infinite component."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def slices_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows x dims) -> least value and number of bits of each dimension, and all
    its bitmaps, dimension by dimension, least significant first."""
    low = values.min(0)
    shifted = values - low
    bits = np.array([int(m).bit_length() for m in shifted.max(0)], np.int64)
    words = -(-len(values) // 64)
    out = np.zeros((int(bits.sum()), words * 8), np.uint8)
    k = 0
    for d, n in enumerate(bits.tolist()):
        for j in range(n):
            packed = np.packbits((shifted[:, d] >> j & 1).astype(np.uint8), bitorder="little")
            out[k, : len(packed)] = packed
            k += 1
    return low, bits, out.view(np.uint64)


def weighted_sum(slices: np.ndarray, bits: np.ndarray, starts: np.ndarray, query: np.ndarray) -> list[np.ndarray]:
    """Slices of sum |q_d| * y_d, where y_d is the shifted value, or its complement
    for a negative q_d: up to a number that all rows share, the inner product."""
    columns: list[list[np.ndarray]] = []
    for d in np.flatnonzero(query):
        weight, at = abs(int(query[d])), int(starts[d])
        own = slices[at: at + int(bits[d])]
        if query[d] < 0:
            own = ~own
        shift = 0
        while weight:
            if weight & 1:
                while len(columns) < shift + len(own):
                    columns.append([])
                for i, bitmap in enumerate(own):
                    columns[shift + i].append(bitmap)
            weight >>= 1
            shift += 1
    out = []
    c = 0
    while c < len(columns):
        column = columns[c]
        while len(column) > 1:
            if c + 1 == len(columns):
                columns.append([])
            a, b = column.pop(), column.pop()
            either = a ^ b
            if column:
                e = column.pop()
                column.append(either ^ e)
                columns[c + 1].append((a & b) | (either & e))
            else:
                column.append(either)
                columns[c + 1].append(a & b)
        out.append(column[0] if column else np.zeros(slices.shape[1], np.uint64))
        c += 1
    return out


def positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def select(total: list[np.ndarray], able: np.ndarray, k: int, few: int) -> tuple[np.ndarray, bool]:
    """Rows that hold the k largest sums among ``able``: either a few candidates to
    resolve, or (True) exactly as many as needed, ties cut by row order."""
    sure, even = np.zeros_like(able), able
    for bitmap in reversed(total):
        if int(np.bitwise_count(sure | even).sum()) <= few:
            return positions(sure | even), False
        more = sure | (even & bitmap)
        n = int(np.bitwise_count(more).sum())
        if n > k:
            even = even & bitmap
        elif n < k:
            sure, even = more, even & ~bitmap
        else:
            return positions(more), False
    rows = positions(sure)
    return np.concatenate([rows, positions(even)[: max(0, k - len(rows))]]), True


def exact_scores(values: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products; Python's integers where longs might overflow."""
    if values.dtype != object and query.dtype != object and values.shape[1] * most(values) * most(query) < LONG:
        return values @ query
    return values.astype(object) @ query.astype(object)


def search_block(ids: np.ndarray, values: np.ndarray, bits: np.ndarray, slices: np.ndarray,
                 query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, row id, score) of each query's k best rows of one block. Rows are
    sorted by id; rows with the query's id are its own and left out."""
    starts = np.concatenate([[0], np.cumsum(bits)])
    every = np.zeros(slices.shape[1] * 8, np.uint8)
    packed = np.packbits(np.ones(len(ids), np.uint8), bitorder="little")
    every[: len(packed)] = packed
    out = []
    for q, query in zip(query_ids.tolist(), queries):
        able = every.copy()
        for row in range(*np.searchsorted(ids, [q, q + 1])):
            able[row >> 3] &= 255 ^ (1 << (row & 7))
        total = weighted_sum(slices, bits, starts, query)
        rows, _ = select(total, able.view(np.uint64), k, 4 * k)
        scores = exact_scores(values[rows], query).tolist()
        best = sorted(zip((-s for s in scores), ids[rows].tolist()))[:k]
        out += [(q, i, -s) for s, i in best]
    return out


def top_k(vectors: DataFrame, query: Column, k: int = 5, scale: float = SCALE, block_rows: int = BLOCK_ROWS,
          batch_queries: int = BATCH_QUERIES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row where ``query`` holds, the k
    other rows with the largest integer inner products, ties to the smaller id.

    Null vectors and vectors with null or non-finite components take no part, nor
    do rows without an id; only vectors of equal length meet; rows with the
    query's id are its own (of a query's rows with different vectors the least
    vector asks). Fewer candidates than k: all. An empty table gives no rows.
    Components may be of any finite size; a score among a query's k best that
    does not fit a long fails the job. Other columns are not read.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    v = F.col(vector_col)
    whole = F.transform(v, lambda x: x.cast("double"))
    rows = written(
        vectors.where(F.col(id_col).isNotNull() & usable(v) & (F.size(v) > 0))
        .select(F.col(id_col).cast("long").alias("vec_id"), F.size(v).alias("dims"), query.alias("asks"), whole.alias("v"), floored(v, scale).alias("same"))
        .dropDuplicates(["vec_id", "same"]).drop("same"), "vectors")
    asked = rows.where("asks").groupBy("dims", "vec_id").agg(F.min("v").alias("v"))
    sizes = written(
        rows.groupBy("dims").agg(F.count("*").alias("n"), F.count_if("asks").alias("asked")).select(
            "dims", F.ceil(F.col("n") / F.least(F.lit(block_rows), F.greatest(F.lit(64), F.floor(F.lit(BLOCK_CELLS) / F.col("dims"))))).alias("blocks"),
            F.ceil(F.greatest(F.lit(1), "asked") / batch_queries).alias("batches")), "sizes").withColumn("lanes", F.ceil(F.col("batches") / BATCHES))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id", kind="stable")
        values = np.array(group["v"].tolist(), np.float64)
        _, bits, slices = slices_of(quantised(values, scale))
        return pd.DataFrame({"dims": [group["dims"].iloc[0]], "block": [group["block"].iloc[0]], "lanes": [group["lanes"].iloc[0]],
                             "ids": [group["vec_id"].to_numpy(np.int64).tobytes()], "v": [values.tobytes()],
                             "bits": [bits.tobytes()], "slices": [slices.tobytes()]})

    dealt = rows.join(sizes, "dims").select("dims", "lanes", "vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), "blocks").alias("block"))
    index = written(dealt.groupBy("dims", "block").applyInPandas(
        build, "dims int, block long, lanes long, ids binary, v binary, bits binary, slices binary"), "slices")
    batches = (asked.join(sizes, "dims").withColumn("batch", F.pmod(F.xxhash64("vec_id", F.lit(3)), "batches"))
               .groupBy("dims", "batch", "blocks", "lanes").agg(F.collect_list(F.struct("vec_id", "v")).alias("asked")))
    # A block comes first in its stream, then the batches that ask it.
    empty, none = F.lit(None).cast("binary"), F.lit(None).cast("array<struct<vec_id: long, v: array<double>>>")
    blocks_first = index.select("dims", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lanes") - 1)).alias("lane"), F.lit(-1).cast("long").alias("batch"),
                                "ids", "v", "bits", "slices", none.alias("asked"))
    then = batches.select("dims", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), (F.col("batch") % F.col("lanes")).alias("lane"),
                          "batch", *(empty.alias(c) for c in ("ids", "v", "bits", "slices")), "asked")
    keys = ["dims", "block", "lane"]
    stream = blocks_first.unionByName(then).repartition(*keys).sortWithinPartitions(*keys, "batch")

    def search(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (r for b in arrow for r in b.to_pylist())
        for _, own in groupby(lines, key=lambda r: (r["dims"], r["block"], r["lane"])):
            b = next(own)
            if b["ids"] is None:  # no row of this length was dealt to the block
                continue
            ids, bits = np.frombuffer(b["ids"], np.int64), np.frombuffer(b["bits"], np.int64)
            slices = np.frombuffer(b["slices"], np.uint64).reshape(int(bits.sum()), -(-len(ids) // 64))
            values = quantised(np.frombuffer(b["v"], np.float64).reshape(len(ids), b["dims"]), scale)
            for r in own:
                queries = [quantised(np.array(a["v"], np.float64), scale) for a in r["asked"]]
                found = search_block(ids, values, bits, slices, np.array([a["vec_id"] for a in r["asked"]], np.int64), queries, k)
                columns = list(zip(*found)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                                                  pa.array([str(s) for s in columns[2]], pa.string())], ["query_id", "vec_id", "score"])

    with batch_rows(spark, 4):
        found = written(stream.mapInArrow(search, "query_id long, vec_id long, score string"), "found")
    # Scores beyond a long rank by their digits.
    negative, digits = F.col("score").startswith("-"), F.regexp_replace("score", "-", "")
    size = F.when(negative, -F.length(digits)).otherwise(F.length(digits))
    order = F.when(negative, F.translate(digits, "0123456789", "9876543210")).otherwise(digits)
    best = Window.partitionBy("query_id").orderBy(size.desc(), order.desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score")))
