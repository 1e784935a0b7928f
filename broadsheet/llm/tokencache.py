"""Token counts through a digest cache.

A text's count depends on its content and on the tokenizer alone, so counts are
kept in a table by two digests: that of the content in its normal form, and that
of the tokenizer's version (library, library version, vocabulary file). A run
digests every text in the JVM, encodes one text for each content digest that the
cache does not hold for this version, appends the new counts, and joins all
documents to the stored ones. A run over known texts encodes nothing.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_facts, make_room, shared_path, small_batches, worker_store, written

LIMIT = 512
# Pieces remembered by a worker, and the longest of them in characters.
PIECES, PIECE = 300_000, 24
CACHE = "content_digest binary, n_tokens long, tokenizer_digest string"
# A blank that a word or sign follows begins a token of a byte-level vocabulary.
JOINT = re.compile(r"(?= \S)")


def tokenizer_version(path: str) -> str:
    """Digest of what decides a count beside the text: library, its version, file."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f"{library} {importlib.metadata.version(library)}\n".encode() + f.read()).hexdigest()


class Counter:
    """Texts -> token counts as the file's own library gives them: nothing added
    at the ends, special strings as the library treats them by itself, whole texts.

    A byte-level vocabulary with the usual pattern and no normaliser never joins
    a token across the start of a blank that something follows. So its texts are
    counted piece by piece, and counts of short pieces are remembered in a
    bounded table. Other vocabularies get their texts whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.known: dict[str, int] = {}
        self.by_piece = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.lengths = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            says = json.load(f)
        cut = says.get("pre_tokenizer") or {}
        self.by_piece = (says.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True)
                         and not cut.get("add_prefix_space")
                         and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in says["added_tokens"]))

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.by_piece:
            return self.lengths(texts)
        out = []
        for text in texts:
            pieces = JOINT.split(text)
            counts = [*map(self.known.get, pieces)]
            misses = [*dict.fromkeys(p for p, n in zip(pieces, counts) if n is None)]
            if misses:
                found = dict(zip(misses, self.lengths(misses)))
                counts = [found[p] if n is None else n for p, n in zip(pieces, counts)]
                make_room(self.known, PIECES)
                self.known.update((p, n) for p, n in found.items() if len(p) <= PIECE)
            out.append(sum(counts))
        return out


def normal(text: Column) -> Column:
    """The normal form of a text of a tokenizer that reads it as it is: null is empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """``content_digest, n_tokens`` stored for a tokenizer version, once for each digest."""
    return (spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer_digest") == version)
            .groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens")))


def append_missing(texts: DataFrame, cache: str, tokenizer: str, version: str) -> None:
    """Encode each text of ``content_digest, content`` whose digest the cache does not
    hold for this version, once, and append the counts. Copies are merged before
    they move, and the cache's digests come by the same shuffle."""
    spark = texts.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = worker_store("counters")
        count = store.get(tokenizer) or store.setdefault(tokenizer, Counter(tokenizer))
        for batch in batches:
            counts = count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["content_digest", "n_tokens"])

    stored = read_cache(spark, cache, version).select("content_digest", F.lit(None).cast("string").alias("content"), F.lit(True).alias("held"))
    distinct = (texts.withColumn("held", F.lit(False)).unionByName(stored).groupBy("content_digest")
                .agg(F.max("content").alias("content"), F.max("held").alias("held")))
    missing = distinct.where("not held").select("content_digest", "content").mapInArrow(encode, "content_digest binary, n_tokens long")
    missing.withColumn("tokenizer_digest", F.lit(version)).write.mode("append").partitionBy("tokenizer_digest").parquet(cache)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = LIMIT,
                 normalise: Callable[[Column], Column] = normal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes`` (UTF-8), ``n_tokens, over_limit`` for every row.

    ``cache`` is a folder that driver and executors share (None: a new one in the
    checkpoint folder); it is made if it is not there and serves any number of
    tokenizers. ``normalise`` gives a text's normal form and must not change its
    count. ``tokenizer`` is a vocabulary file at the same place on every machine.
    Null texts count as empty ones, with 0 tokens; null ids and repeated rows stay rows of
    their own; an empty table gives no rows; other columns are not read. A digest
    that two runs appended at once counts once.
    """
    spark = docs.sparkSession
    small_batches(spark)
    cache = cache or shared_path(spark, "token-counts")
    version = tokenizer_version(tokenizer)
    spark.createDataFrame([], CACHE).write.mode("append").partitionBy("tokenizer_digest").parquet(cache)
    content = normalise(F.col(text_col))
    digest = F.unhex(F.sha2(content.cast("binary"), 256))
    base = written(docs.select(F.col(id_col), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("__bytes"),
                               digest.alias("content_digest")), "digests")
    known = read_cache(spark, cache, version).select("content_digest")
    if base.select("content_digest").distinct().join(known, "content_digest", "left_anti").limit(1).count():
        append_missing(docs.select(digest.alias("content_digest"), content.alias("content")), cache, tokenizer, version)
    counted = join_facts(base, read_cache(spark, cache, version), "content_digest")
    return counted.select(id_col, F.col("__bytes").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
