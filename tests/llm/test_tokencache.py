"""Token counts against the plain library, and what the cache does."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from broadsheet.llm import tokencache
from broadsheet.llm.common import join_facts, shared_path, written

from .conftest import table

FILE = "byte_bpe_50k.json"


def plain(path):
    if path.endswith(".model"):
        import sentencepiece
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(m.encode(t))
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    return lambda x: len(t.encode(x, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", [FILE, "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_are_the_librarys(spark, odd_docs, name):
    path = public_tokenizers.path(name)
    count = plain(path)
    rows = tokencache.count_tokens(odd_docs, path).collect()
    texts = odd_docs.select("doc_id", "text").collect()
    expect = sorted((str(i), len((t or "").encode()), count(t or ""), count(t or "") > 512) for i, t in texts)
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in rows) == expect


def test_pieces_count_like_whole_texts():
    count, whole = tokencache.Counter(public_tokenizers.path(FILE)), plain(public_tokenizers.path(FILE))
    import random
    rng = random.Random(3)
    signs = [" ", " ", "  ", "\n", " \n ", "\t", "\x1c", " ", "　", "a", "don't", "'s", "é", "12", "!?", "<|endoftext|>", "\r\n", "\x85", "日本"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(12))) for _ in range(4000)]
    assert count.by_piece
    assert count(texts) == [whole(t) for t in texts]
    assert count(texts) == [whole(t) for t in texts]


def test_all_documents(spark):
    docs = table(spark, "documents")
    count = plain(public_tokenizers.path(FILE))
    got = sorted(map(tuple, tokencache.count_tokens(docs, public_tokenizers.path(FILE)).select("doc_id", "n_tokens").collect()))
    assert got == sorted((r.doc_id, count(r.text or "")) for r in docs.collect())


def test_only_distinct_misses_are_encoded(spark):
    path, cache = public_tokenizers.path(FILE), shared_path(spark, "cache")
    docs = spark.createDataFrame([(1, "one"), (2, "one"), (3, "two words"), (4, None), (5, "")], "doc_id long, text string")

    def stored():
        return spark.read.parquet(cache).groupBy("tokenizer_digest").count().orderBy("count").collect()

    first = tokencache.count_tokens(docs, path, cache).collect()
    assert [r["count"] for r in stored()] == [3]
    assert tokencache.count_tokens(docs, path, cache).orderBy("doc_id").collect() == sorted(first)
    assert [r["count"] for r in stored()] == [3]
    more = docs.unionByName(spark.createDataFrame([(6, "new text"), (7, "new text")], docs.schema))
    assert tokencache.count_tokens(more, path, cache).count() == 7
    assert [r["count"] for r in stored()] == [4]
    tokencache.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), cache)
    assert [r["count"] for r in stored()] == [3, 4]


def test_stored_counts_are_used_and_repeats_count_once(spark):
    path, cache = public_tokenizers.path(FILE), shared_path(spark, "cache")
    docs = spark.createDataFrame([(1, "one")], "doc_id long, text string")
    tokencache.count_tokens(docs, path, cache)
    entry = spark.read.schema(tokencache.CACHE).parquet(cache).withColumn("n_tokens", F.lit(700).cast("long"))
    entry = written(entry, "entry")
    entry.unionByName(entry).write.mode("append").partitionBy("tokenizer_digest").parquet(cache)
    assert tokencache.count_tokens(docs, path, cache).collect() == [(1, 3, 700, True)]


def test_empty_table_and_clashing_columns(spark, no_docs):
    path = public_tokenizers.path(FILE)
    assert tokencache.count_tokens(no_docs, path).collect() == []
    docs = spark.createDataFrame([(1, "a b", 9, 9, "x", b"y")], "doc_id long, text string, n_tokens int, n_bytes int, content_digest string, held binary")
    assert tokencache.count_tokens(docs, path).collect() == [(1, 3, 2, False)]


def test_join_facts_keeps_every_row(spark):
    rows = written(spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k")), "rows")
    facts = rows.select("k", (F.col("k") * 2).alias("v")).distinct()
    got = join_facts(rows, facts, "k")
    assert got.count() == 3000 and got.where("v <> 2 * k").count() == 0
