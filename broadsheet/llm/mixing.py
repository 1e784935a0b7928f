"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by (source, exact length). A source whose target is t
words over a size of S is taken whole floor(t / S) times; what is left of the
budget is filled from one more copy of some documents: an even share of every
length first, then one document more of the longest lengths that fit, and the
last few thousand words by bounded-knapsack dynamic programming, which finds the
subset of the remaining length counts whose sum is nearest to the budget.
Documents of a length are chosen by seeded hash, exactly as many as planned.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import put_aside, put_back, ranked, written

WORD = r"[^\x20\x09-\x0D]+"
# Budget that the dynamic programme fits exactly; sums are bits of one integer.
TABLE_WORDS = 1 << 16


def fit(lengths: list[int], counts: list[int], budget: int, table: int = TABLE_WORDS) -> list[int]:
    """How many documents of each length to take so that their words come as near
    to ``budget`` as found (the nearest sum, and of two the smaller, once the even
    share is taken). Lengths are positive and distinct."""
    whole = sum(n * c for n, c in zip(lengths, counts))
    if budget <= 0 or not whole:
        return [0] * len(lengths)
    if budget >= whole:
        return list(counts)
    take = [c * budget // whole for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, take))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:
        if left <= table // 2:
            break
        more = min(counts[i] - take[i], (left - table // 2) // lengths[i])
        take[i] += more
        left -= more * lengths[i]
    if left > table:
        for i in order:
            more = min(counts[i] - take[i], left // lengths[i])
            take[i] += more
            left -= more * lengths[i]
    if left <= 0 or left > table:
        return take
    # Reachable sums as bits; a bounded count is split into powers of two.
    mask, reach, steps = (1 << (2 * left + 1)) - 1, 1, []
    for i in order[::-1]:
        most = min(counts[i] - take[i], 2 * left // lengths[i])
        part = 1
        while most > 0 and not reach >> left & 1:
            k = min(part, most)
            after = (reach | reach << k * lengths[i]) & mask
            if after != reach:
                steps.append((i, k, reach))
                reach = after
            most -= k
            part *= 2
    at, above = (reach & ((1 << (left + 1)) - 1)).bit_length() - 1, reach >> (left + 1)
    if above and (over := (above & -above).bit_length()) < left - at:
        at = left + over
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            take[i] += k
            at -= k * lengths[i]
    return take


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """``source, source_size`` -> plus ``target``: all words shared by weight, in
    code point order (null last) of the sources, repeating ``weights``; a target
    stops at ``most`` times its source's size and the excess is shared again by
    weight among the others. One row for each source; the sources that stop are
    a prefix in the order of cap over weight, so one sorted pass finds the level."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("_ratio", "_k")
    whole = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("_k", F.lit(len(weights))) + 1).cast("int"))
    t = (sizes.withColumn("_k", F.row_number().over(by_name) - 1).withColumn("_w", w)
         .withColumn("_cap", F.col("source_size") * most).withColumn("_ratio", F.col("_cap") / F.col("_w")))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    t = (t.withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
         .withColumn("_open", F.sum("_w").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
         .withColumn("_level", (F.sum("source_size").over(whole) - F.col("_capped")) / F.col("_open")))
    level = F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(whole)
    return (t.withColumn("target", F.least("_cap", F.coalesce(level, F.col("_ratio")) * F.col("_w")))
            .select("source", "source_size", "target"))


PLAN = "__has boolean, __source string, __size long, __times long, __extra long, source_size long, target double"


def _plan(group: pd.DataFrame) -> pd.DataFrame:
    """One source's histogram -> times every document is taken, and how many of
    each length once more."""
    size, budget = int(group["source_size"].iloc[0]), int(round(float(group["target"].iloc[0])))
    group = group.sort_values("__size")
    group["__times"] = budget // size if size else 0
    group["__extra"] = 0
    some = group["__size"] > 0
    if size:
        group.loc[some, "__extra"] = fit(group.loc[some, "__size"].tolist(), group.loc[some, "__n"].tolist(), budget % size)
    return group[["__has", "__source", "__size", "__times", "__extra", "source_size", "target"]]


def mix(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0, source_col: str = "source",
        size_col: str = "size", content_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Add to every document ``source_size``, ``target`` (of its source, in words)
    and ``copies`` (how often the mix takes it); columns of these names are
    replaced, all others stay. ``size_col`` counts a document's words;
    ``content_col`` tells documents with equal ids apart.

    Null sizes count as 0; documents without words take no part: 0 copies. The
    null source is a source, last in order. Repeated rows are documents of their
    own. An empty table gives no rows. ``docs`` is read twice and should be a
    table, not a long plan. Equal input gives an equal mix.
    """
    keys = ["__has", "__source", "__size"]
    docs = docs.drop("source_size", "target", "copies").select(
        "*", F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("__size"),
        F.col(source_col).isNotNull().alias("__has"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__source"))
    counts = written(docs.groupBy(*keys).agg(F.count("*").alias("__n")), "lengths")
    sizes = counts.groupBy("__has", "__source").agg(F.sum(F.col("__size") * F.col("__n")).alias("source_size"))
    goal = targets(sizes.select(F.when(F.col("__has"), F.col("__source")).alias("source"), "source_size"), weights, most)
    goal = goal.select(F.col("source").isNotNull().alias("__has"), F.coalesce("source", F.lit("")).alias("__source"),
                       "source_size", "target")
    plan = written(counts.join(goal, ["__has", "__source"]).groupBy("__has", "__source").applyInPandas(_plan, PLAN), "mix_plan")
    order = [F.lit(seed), F.col(id_col), F.xxhash64(content_col)]
    out = ranked(docs, keys, order, "__rank", facts=plan)
    copies = F.when(F.col("__size") > 0, F.col("__times") + (F.col("__rank") < F.col("__extra")).cast("long")).otherwise(F.lit(0))
    return out.withColumn("copies", copies.cast("long")).drop("__has", "__source", "__size", "__times", "__extra", "__rank")


# Columns that ``mix`` adds.
MADE = ("source_size", "target", "copies")


def mixed_documents(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with the
    columns of ``docs``. A document's words are its text's (null: none)."""
    sized = put_aside(docs, MADE).withColumn("__words", F.regexp_count(text_col, F.lit(WORD)))
    took = mix(sized, size_col="__words", content_col=text_col, **options).where("copies > 0")
    return put_back(took.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))), docs.columns, MADE)
