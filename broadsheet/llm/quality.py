"""Quality classifier: random-indexing word vectors, pooled, and a small network.

Every word bucket owns a sparse random index vector of +1 and -1. A word's vector
is the sum of the index vectors of its neighbours over the whole corpus: each task
adds up its texts, and the sums of all tasks are added bucket block by block. A
document is the mean of its words' unit vectors. A two-layer numpy network learns
labels from a bounded sample of labelled documents; its temperature is fitted on
rows it has not trained on, so that scores are calibrated probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Chunks, small_batches, worker_store, written

# Hash buckets for words, their dimensions, and the +-1s of an index vector.
BUCKETS, DIM, MARKS, REACH = 1 << 15, 64, 4, 2
BLOCK = 256
SAMPLE = 20_000
THRESHOLD = 0.3
SHAPE = re.compile(r"(\W*)(.*?)(\W*)", re.DOTALL)
CHUNKS = 400_000
# Words that are held, whose contexts are added up together, and whose vectors are.
TOKENS, STRETCH, PART = 1_000_000, 1 << 18, 1 << 16


def index_vectors(seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the places and signs of its marks; the last row, which
    stands between documents, has none."""
    rng = np.random.default_rng(seed)
    at = rng.integers(0, DIM, (BUCKETS + 1, MARKS))
    sign = rng.choice([-1.0, 1.0], (BUCKETS + 1, MARKS))
    sign[BUCKETS] = 0
    return at, sign


def bucket(word: str) -> bytes:
    """A word's bucket, as a little-endian unsigned 16-bit number."""
    return (zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS).to_bytes(2, "little")


def chunk_ids(chunk: str) -> bytes:
    """Buckets of a chunk without white space: what stands before the word, the
    word (with a mark if all capitals) and what stands behind it."""
    before, word, after = ("", chunk, "") if chunk.isalpha() else SHAPE.fullmatch(chunk).groups()
    out = bucket(before) if before else b""
    if word:
        out += bucket(("^" if len(word) > 1 and word.isupper() else "") + word.lower())
    return out + bucket(after) if after else out


class Words:
    """Texts -> word buckets, with a bounded table of chunks."""

    def __init__(self):
        self.chunks = Chunks(chunk_ids, CHUNKS)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of all texts, and where each text's begin and end."""
        data, at = self.chunks(texts)
        return np.frombuffer(data, "<u2"), at // 2


def words() -> Words:
    return worker_store("quality").setdefault("words", Words())


def add_contexts(total: np.ndarray, ids: np.ndarray, at: np.ndarray, sign: np.ndarray) -> None:
    """Add to each word the index vectors of the words up to REACH away."""
    at, sign = at.T.copy(), sign.T.copy()
    for first in range(0, len(ids), STRETCH):
        pairs = []
        for step in range(1, REACH + 1):
            right = ids[first + step: first + step + STRETCH].astype(np.int64)
            left = ids[first: first + len(right)].astype(np.int64)
            pairs += [(left, right), (right, left)]
        rows, near = (np.concatenate(side) for side in zip(*pairs))
        rows *= DIM
        for m in range(MARKS):
            total += np.bincount(rows + at[m][near], sign[m][near], total.size)


def word_vectors(docs: DataFrame, text_col: str = "text", seed: int = 1) -> np.ndarray:
    """Unit word vectors (BUCKETS x DIM) from all texts. The result's size does not
    depend on the corpus; each task sends at most that much, in blocks, which are
    added up in two steps so that no task gathers a block from all others."""
    small_batches(docs.sparkSession)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sign = index_vectors(seed)
        total, read = np.zeros((BUCKETS + 1) * DIM), words()
        held: list[np.ndarray] = []

        def flush():
            if held:
                add_contexts(total, np.concatenate(held), at, sign)
                held.clear()

        for batch in batches:
            ids, ends = read(batch.column(0))
            held.append(np.insert(ids, np.repeat(ends[1:], REACH), BUCKETS))
            if sum(map(len, held)) >= TOKENS:
                flush()
        flush()
        found = total[: BUCKETS * DIM].reshape(-1, BLOCK * DIM)
        some = np.flatnonzero(found.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array([TaskContext.get().partitionId() % 16] * len(some), pa.int32()),
             pa.array([found[b].astype("<f4").tobytes() for b in some], pa.binary())], ["block", "part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                more = np.frombuffer(data, "<f4").astype(float)
                held[b] = held[b] + more if b in held else more
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array([0] * len(held), pa.int32()),
             pa.array([v.astype("<f4").tobytes() for v in held.values()], pa.binary())], ["block", "part", "sums"])

    kind = "block int, part int, sums binary"
    made = docs.select(text_col).mapInArrow(sums, kind).repartition("block", "part").mapInArrow(add, kind)
    made = written(made.repartition("block").mapInArrow(add, kind), "word_vectors")
    out = np.zeros((BUCKETS // BLOCK, BLOCK * DIM), np.float32)
    for r in made.select("block", "sums").collect():
        out[r["block"]] = np.frombuffer(r["sums"], "<f4")
    out = out.reshape(BUCKETS, DIM)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    unit = out / np.maximum(size, 1e-9)
    known = size[:, 0] > 0
    if known.any():  # the direction all words share says nothing
        unit[known] -= unit[known].mean(0)
    return unit.astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray, read: Words) -> np.ndarray:
    """The mean vector of each text's words, summed in double precision; zero for a
    text without words."""
    out = np.zeros((len(texts), DIM), np.float32)
    ids, at = read(texts)
    for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        if a < b:
            parts = [ids[c: min(c + PART, b)] for c in range(a, b, PART)]
            out[k] = sum(np.ones(len(p)) @ vectors.take(p, 0) for p in parts) / (b - a)
    return out


class Network:
    """Two layers: tanh, then a logit, divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 16, epochs: int = 60, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(DIM), np.ones(DIM))
        n = x.shape[1]
        self.w1, self.b1 = rng.normal(0, n ** -0.5, (n, hidden)), np.zeros(hidden)
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        self.w2, self.b2 = np.zeros(hidden), np.log(share / (1 - share))
        self.temperature = 1.0
        if len(np.unique(y)) < 2:
            return
        held = rng.random(len(x)) < 0.15
        z = (x - self.mean) / self.scale
        self._train(z[~held], y[~held], epochs, rng)
        if held.any():
            logits = self.logits(x[held])
            tries = np.geomspace(0.3, 5, 60)
            loss = [np.logaddexp(0, np.where(y[held] == 1, -logits, logits) / t).mean() for t in tries]
            self.temperature = float(tries[int(np.argmin(loss))])

    def _train(self, z: np.ndarray, y: np.ndarray, epochs: int, rng, rate: float = 0.01, decay: float = 1e-4) -> None:
        """Adam on the logistic loss."""
        names = ["w1", "b1", "w2", "b2"]
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        v = {k: np.zeros_like(getattr(self, k)) for k in names}
        t = 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(z)), max(1, len(z) // 256)):
                h = np.tanh(z[rows] @ self.w1 + self.b1)
                e = (1 / (1 + np.exp(-(h @ self.w2 + self.b2))) - y[rows]) / len(rows)
                back = np.outer(e, self.w2) * (1 - h * h)
                grads = {"w1": z[rows].T @ back + decay * self.w1, "b1": back.sum(0), "w2": h.T @ e + decay * self.w2, "b2": e.sum()}
                t += 1
                for k in names:
                    m[k] = 0.9 * m[k] + 0.1 * grads[k]
                    v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                    setattr(self, k, getattr(self, k) - rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0: never trained on. A null id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, sample: int = SAMPLE) -> Network:
    """Train on at most ``sample`` labelled documents outside the held-out fifth,
    the first by hash of id. Labels other than 0 and 1 are ignored; an id with
    both counts as the larger. Without labels every score is one half; with one
    kind of label, that kind's share, kept off 0 and 1."""
    some = (labels.where("quality in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("__quality"))
            .orderBy(F.xxhash64("doc_id")).limit(sample))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vectors.astype(float)
        for batch in batches:
            x = pooled(batch.column(1), known, words())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([v.tobytes() for v in x], pa.binary())],
                                             ["doc_id", "quality", "x"])

    # The sample is bounded by its parameter, so it may be sent to every task.
    rows = (docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "text", F.col("__quality").alias("quality"))
            .mapInArrow(pool, "doc_id long, quality int, x binary")
            .groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("x").alias("x")).orderBy("doc_id").collect())
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], float).reshape(-1, DIM)
    return Network(x, np.array([r["quality"] for r in rows], float))


# Columns that ``score_documents`` adds.
MADE = ("held_out", "score", "predicted")


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``held_out, score, predicted`` to every row of ``docs`` (columns of these
    names are replaced). Only the text enters a score; an empty or null text is
    scored as one without words. Repeated rows stay; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    vectors = word_vectors(docs)
    net = fit(docs, labels, vectors, sample)
    sent = spark.sparkContext.broadcast(vectors)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = sent.value.astype(float)
        for texts in batches:
            yield pd.Series(net.score(pooled(pa.array(texts, pa.string(), from_pandas=True), known, words())))

    return (docs.drop("held_out", "score", "predicted").withColumn("held_out", held_out()).withColumn("score", score("text"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
