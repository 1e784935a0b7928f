"""Helpers shared by the operators: shared-folder tables and a distributed rank."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from broadsheet.session import checkpoint_dir

# Rows of one Arrow batch. Texts may be long, so batches stay small.
ARROW_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once. The operators are lazy, so the
    setting stays in the caller's session; it changes no result."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what runs inside the block."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: the lineage is
    cut, a lost executor costs only the tasks it ran, and nothing upstream runs
    again for the second reader."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put_aside(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Columns that an operator's results would replace, under private names."""
    return df.withColumnsRenamed({c: f"__own_{c}" for c in names if c in df.columns})


def put_back(df: DataFrame, columns: list[str], names: tuple[str, ...]) -> DataFrame:
    """The columns ``columns`` with the values that ``put_aside`` kept."""
    return df.select(*(F.col(f"__own_{c}").alias(c) if c in names else F.col(f"`{c}`") for c in columns))


def worker_store(name: str) -> dict:
    """A dictionary that lives in the Python worker, for caches that several tasks
    of a worker use. A worker serves one operator after the other; it holds the
    caches of one at a time, so that a pipeline's stages don't add up."""
    stores = sys.modules.setdefault("_broadsheet_llm_worker", types.ModuleType("store")).__dict__.setdefault("stores", {})
    for other in [k for k in stores if k != name]:
        del stores[other]
    return stores.setdefault(name, {})


def make_room(cache: dict, most: int) -> None:
    """Drop the older half of a cache that holds ``most`` entries."""
    if len(cache) >= most:
        for key in [*islice(cache, most // 2)]:
            del cache[key]


# A letter, the signs behind it, and the end of the chunk.
SIGNS = "[!-/:-@\\[-^`{-~]"
ENDED = rf"([A-Za-zÀ-ÖØ-öø-ÿ])({SIGNS}+)([ \t\n\r]|$)"


class Chunks:
    """What each chunk between white space stands for, as bytes, for a batch of
    texts together: Arrow splits the texts and numbers their distinct chunks, only
    those are looked up, and Arrow puts the bytes in place. Signs that end a chunk
    behind a letter are a chunk of their own, so that a word is one chunk with and
    without them. ``known`` is a bounded table of chunks seen before."""

    def __init__(self, made, most: int):
        self.made, self.most = made, most
        self.known: dict[str, bytes] = {"": b""}

    def meaning(self, chunk: str) -> bytes:
        found = self.made(chunk)
        if len(chunk) < 40:
            make_room(self.known, self.most)
            self.known[chunk] = found
        return found

    def __call__(self, texts: pa.Array) -> tuple[memoryview, np.ndarray]:
        """All bytes of the batch, and where each text's begin and end (one number
        more than texts). A null text has none."""
        parts = pc.utf8_split_whitespace(pc.replace_substring_regex(texts, ENDED, r"\1 \2\3"))
        counts = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False)
        codes = parts.flatten().dictionary_encode()
        get, meaning = self.known.get, self.meaning
        values = [meaning(c) if (b := get(c)) is None else b for c in codes.dictionary.to_numpy(zero_copy_only=False)]
        if not len(codes):
            return memoryview(b""), np.zeros(len(texts) + 1, np.int64)
        sizes = np.fromiter(map(len, values), np.int64, len(values))[codes.indices.to_numpy()]
        at = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
        data = pa.array(values, pa.large_binary()).take(codes.indices).buffers()[2]
        return memoryview(data or b""), at


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str, bits: int = 10,
           facts: DataFrame | None = None) -> DataFrame:
    """Add ``name``, the 0-based rank of each row within ``keys`` in the order of
    (hash of ``order``, ``order``), without one task for a hot key.

    A key's rows fall into ``2**bits`` hash ranges; each range is ranked by
    itself and starts at the number of rows in the ranges before it. ``keys``
    must not be null. ``facts``, one row for each key, is joined to the ranges'
    starts, so that its columns arrive by the same shuffle, which no hot key
    holds up. ``df`` is read twice, so it should be a written table. Rows equal
    in all of ``order`` may swap ranks.
    """
    df = df.withColumn("__range", F.shiftrightunsigned(F.xxhash64(*order), 64 - bits))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (df.groupBy(*keys, "__range").agg(F.count("*").alias("__n"))
              .select(*keys, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")))
    if facts is not None:
        starts = starts.join(facts, keys)
    within = Window.partitionBy(*keys, "__range").orderBy(F.xxhash64(*order), *order)
    return (df.join(starts, [*keys, "__range"])
            .withColumn(name, F.col("__start") + F.row_number().over(within) - 1)
            .drop("__range", "__start"))


def join_facts(rows: DataFrame, facts: DataFrame, key: str, share: int = 1024) -> DataFrame:
    """Join ``rows`` to ``facts``, which has one row for each ``key``, without one
    task for a hot key. Keys that hold more than 1/``share`` of all rows are fewer
    than ``share``; their facts are broadcast, all others meet by shuffle. Null keys
    join nothing. ``rows`` is read several times, so it should be a written table."""
    total = rows.count()
    hot = rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") * share > total).select(key)
    few = written(facts.join(F.broadcast(hot), key, "left_semi").withColumn("__hot", F.lit(True)), "hot")
    apart = rows.join(F.broadcast(few.select(key, "__hot")), key, "left")
    warm = rows.join(F.broadcast(few.drop("__hot")), key)
    return warm.unionByName(apart.where("__hot is null").drop("__hot").hint("merge").join(facts, key))
