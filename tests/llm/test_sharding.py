import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from broadsheet.llm import sharding

from .conftest import table


def check(rows, docs, shards):
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_documents_keep_copies_together_at_equal_sizes(spark):
    docs = table(spark, "documents").select("doc_id", "text")
    got = sharding.shard_documents(docs, 4).collect()
    given = [tuple(r) for r in docs.collect()]
    check(got, given, 4)
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert max(load.values()) - min(load.values()) < 0.02 * sum(load.values()) / 4
    text = dict(given)
    copies = defaultdict(list)
    for r in got:
        copies[text[r["doc_id"]]].append(r["shard"])
    groups = [c for c in copies.values() if len(c) > 1]
    cut = sum(len(c) - max(Counter(c).values()) for c in groups)
    assert cut <= 0.1 * sum(map(len, groups))


def test_odd_rows_and_empty_table(spark, odd_docs, no_docs):
    check(sharding.shard_documents(odd_docs, 3).collect(), [(r["doc_id"], r["text"]) for r in odd_docs.collect()], 3)
    assert sharding.shard_documents(no_docs, 3).collect() == []


def test_hot_link_is_spread_and_balanced(spark):
    rows = spark.range(3000).select(F.col("id").alias("row"), F.lit(10).cast("long").alias("weight"),
                                    F.when(F.col("id") < 1000, F.array(F.lit(7).cast("long")))
                                    .when(F.col("id") < 2000, F.array((F.col("id") % 300).cast("long") + 100)).alias("links"))
    got = {r["row"]: r["shard"] for r in sharding.propagate(rows, 8).collect()}
    load = Counter(got.values())
    assert len(got) == 3000 and max(load.values()) - min(load.values()) <= 8
    hot = Counter(got[k] for k in range(1000))
    assert sum(n for _, n in hot.most_common(6)) >= 900, hot  # not dealt over all shards
    split = sum(len({got[k] for k in range(1000, 2000) if k % 300 == g}) > 1 for g in range(300))
    assert split <= 60


def test_links_of_a_graph_with_several_links_for_a_row(spark):
    # Cliques of ten; one edge joins each to the next.
    clique, edge = F.floor(F.col("id") / 10), F.floor((F.col("id") + 1) / 10) + 1000
    joins = (F.col("id") % 10).isin(0, 9)
    rows = spark.range(400).select(F.col("id").alias("row"), F.lit(1).cast("long").alias("weight"),
                                   F.when(joins, F.array(clique, edge)).otherwise(F.array(clique)).alias("links"))
    got = {r["row"]: r["shard"] for r in sharding.propagate(rows, 4).collect()}
    load = Counter(got.values())
    assert len(got) == 400 and max(load.values()) - min(load.values()) <= 12, load
    whole = sum(len({got[c * 10 + j] for j in range(10)}) == 1 for c in range(40))
    assert whole >= 25, whole


def test_pairs_and_triples_alone_come_together(spark):
    for copies, texts in ((2, 900), (3, 600)):
        docs = spark.range(copies * texts).select(
            F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.lpad((F.col("id") % texts).cast("string"), 6, "0")).alias("text"))
        got = sharding.shard_documents(docs, 8).collect()
        check(got, [tuple(r) for r in docs.collect()], 8)
        held, load = defaultdict(set), Counter()
        for r in got:
            held[r["doc_id"] % texts].add(r["shard"])
            load[r["shard"]] += r["size"]
        split = sum(len(s) > 1 for s in held.values())
        mean = sum(load.values()) / 8
        assert split <= 0.01 * texts, split
        assert max(load.values()) - min(load.values()) <= 0.03 * mean, load
