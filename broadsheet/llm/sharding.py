"""Sharding by balanced label propagation.

Every linked row starts in a shard drawn from its row number. In each round a
row looks at the shards of its neighbours (the rows that share one of its
links), and asks to move to the shard that holds most of them by weight; equal
votes of small groups are broken in an order of each link's own, so that wishes
flow both ways. Moves
are granted up to a quota for each (from, to) pair of shards: what moves the
other way, plus the target's spare capacity; moves that do not all fit are
granted in part, small groups by link hash, others by row hash. When the wishes
fall no more, groups that are still split and share no row with another link are
put whole into the gaps, rows without links fill the shards up to equal weight,
and a few levelling passes move small groups and rows out of what is still too heavy.

Only sums by (shard, shard, 64 priority buckets) and split groups of over 1/64
of a shard (at most 64 for each shard) reach the driver; rows never do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ranked, written

PRIORITIES = 64
RANGES = 1024
SMALL, ROUNDS = 64, 8


def propagate(rows: DataFrame, shards: int, rounds: int | None = None, passes: int = 4) -> DataFrame:
    """Put weighted, linked rows into ``shards`` shards of near-equal weight.

    ``rows``: ``row`` (unique long), ``weight`` (positive long), ``links`` (array
    of long, null or empty for none); rows that share a link are neighbours.
    Returns ``row, weight, shard``. A link that holds more than half a shard is
    split into parts by row hash first, so that its rows spread over as few
    shards as hold them. ``rounds`` bounds the rounds; None: at least ROUNDS, until
    the wishes fall no more. An empty table gives an empty result. With fewer rows
    than shards, or one row heavier than a shard, the weights are as equal as
    whole rows allow.
    """
    total = rows.agg(F.sum("weight").alias("w")).first()["w"] or 0
    room = total / shards
    members = rows.select("row", "weight", F.explode(F.array_distinct("links")).alias("link")).where("link is not null")
    heavy = members.groupBy("link").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).where("n > 1")
    heavy = heavy.select("link", "w", F.greatest(F.lit(1), F.ceil(F.col("w") / max(1.0, room / 2))).alias("parts"))
    members = members.join(heavy, "link").select(
        "row", "weight", F.xxhash64("link", F.pmod(F.xxhash64("row"), "parts")).alias("link"), (F.col("w") / F.col("parts")).alias("mass"))
    # A row follows its heaviest link where votes are equal.
    leads = members.groupBy("row").agg(F.max_by("link", F.struct("mass", "link")).alias("lead"), F.count("*").alias("n"))
    members = written(members.drop("mass").join(leads, "row"), "members")

    state = members.groupBy("row").agg(F.first("weight").alias("weight"), F.first("lead").alias("lead"), F.first("n").alias("n"))
    state = written(state.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(17)), F.lit(shards)).cast("int")), "labels")
    shared = members.join(state.where("n > 1").select("row"), "row").select(F.col("link").alias("lead"), F.lit(1).alias("open")).distinct()
    state = (state.join(shared, "lead", "left").withColumn("unit", F.when(F.col("open").isNull(), F.col("lead")))
             .select("row", "weight", "lead", "unit", "shard"))
    best, idle, turn = None, 0, 0
    while rounds is None or turn < rounds:
        wishes, state = _round(members, state, shards, room)
        turn += 1
        idle = 0 if best is None or wishes < best else idle + 1
        best = wishes if best is None else min(best, wishes)
        if not wishes or idle >= 2 and turn >= ROUNDS:
            break
    state = _whole(state, shards, room)

    loose = rows.join(state, "row", "left_anti").select("row", "weight")
    linked = state.select("row", "weight", "unit", "shard")
    gaps = [max(0.0, room - x) for x in _loads(linked, shards)]
    state = linked.withColumn("fixed", F.lit(1)).unionByName(
        _fill(loose, gaps).withColumn("fixed", F.lit(0)).withColumn("unit", F.lit(None).cast("long")))
    alone = F.xxhash64(F.lit("row"), "row")
    state = written(state.withColumn("piece", F.when(F.col("unit").isNull(), alone).otherwise(F.xxhash64(F.lit("unit"), "unit"))), "filled")
    # Whole groups first; single rows only where a shard stays over by a hundredth.
    for piece, tolerance in ((F.col("piece"), 2e-4), (alone, 1e-2)):
        state = state.withColumn("piece", piece)
        for _ in range(passes):
            over, state = _level(state, shards, room, tolerance)
            if not over:
                break
    return state.select("row", "weight", "shard")


def _loads(state: DataFrame, shards: int) -> list[float]:
    """Weight of every shard: at most one row for each reaches the driver."""
    found = {r["shard"]: r["w"] for r in state.groupBy("shard").agg(F.sum("weight").alias("w")).collect()}
    return [float(found.get(s, 0)) for s in range(shards)]


def _round(members: DataFrame, state: DataFrame, shards: int, room: float) -> tuple[int, DataFrame]:
    """The weight of the rows that asked to move (0: none may), and the state after."""
    labelled = members.join(state.select("row", "shard"), "row")
    votes = labelled.groupBy("link", "shard").agg(F.sum("weight").alias("votes"))
    wanted = (members.select("row", "lead", "link").join(votes, "link")
              .groupBy("row", "lead", "shard").agg(F.sum("votes").alias("votes"))
              .groupBy("row").agg(F.max_by("shard", F.struct("votes", F.xxhash64("lead", "shard"))).alias("own"),
                                  F.max_by("shard", F.struct("votes", F.xxhash64("shard"))).alias("common"),
                                  F.sum("votes").alias("near"))
              .select("row", "near", F.when(F.col("near") <= room / SMALL, F.col("own")).otherwise(F.col("common")).alias("to")))
    asked = written(state.join(wanted, "row").withColumn("turn", F.pmod(F.xxhash64("lead"), F.lit(PRIORITIES))), "asked")
    by = {}
    for r in (asked.where("shard <> to").groupBy("shard", "to", "turn").agg(F.sum("weight").alias("w"))
              .orderBy("shard", "to", "turn").collect()):
        by.setdefault((r["shard"], r["to"]), []).append((r["turn"], r["w"]))
    loads = _loads(asked, shards)
    moving = {pair: sum(w for _, w in turns) for pair, turns in by.items()}
    into = {b: sum(w for (_, t), w in moving.items() if t == b) for b in range(shards)}
    grants = []
    for (a, b), turns in by.items():
        quota = min(moving[a, b], moving.get((b, a), 0)) + max(0.0, room - loads[b]) * moving[a, b] / into[b]
        for turn, w in turns:
            part = min(1000, int(1000 * max(0.0, quota) / w))
            if part:
                grants.append((a, b, turn, part))
                quota -= w * part / 1000
    if not grants:
        return 0, state
    limits = asked.sparkSession.createDataFrame(grants, "shard int, to int, turn long, part int")
    drawn = F.when(F.col("near") <= room / SMALL, F.col("lead")).otherwise(F.col("row"))
    goes = F.pmod(F.xxhash64(drawn, F.lit(23)), F.lit(1000)) < F.coalesce("part", F.lit(0))
    after = asked.join(limits, ["shard", "to", "turn"], "left").withColumn("shard", F.when(goes, F.col("to")).otherwise(F.col("shard")))
    return sum(moving.values()), written(after.select("row", "weight", "lead", "unit", "shard"), "labels")


def _whole(state: DataFrame, shards: int, room: float) -> DataFrame:
    """Put split units whole into the gaps that they leave: the large ones by the
    largest gap, unless they overfill it, the small ones in line."""
    split = (state.where("unit is not null").groupBy("unit")
             .agg(F.sum("weight").alias("weight"), F.min("shard").alias("a"), F.max("shard").alias("b")).where("a <> b"))
    split = written(split.select(F.col("unit").alias("row"), "weight"), "split")
    gaps = [room - x for x in _loads(state.join(split.select(F.col("row").alias("unit")), "unit", "left_anti"), shards)]
    fits, left = [], []
    for r in split.where(F.col("weight") > room / SMALL).orderBy(F.desc("weight"), "row").collect():
        s = max(range(shards), key=lambda x: gaps[x])
        if gaps[s] + room / SMALL >= r["weight"]:
            fits.append((r["row"], s))
            gaps[s] -= r["weight"]
        else:
            left.append((r["row"],))
    spark = state.sparkSession
    stay = spark.createDataFrame(left, "unit long")
    for s, w in enumerate(_loads(state.join(stay, "unit"), shards)):
        gaps[s] -= w
    small = _fill(split.where(F.col("weight") <= room / SMALL), [max(0.0, g) for g in gaps])
    placed = small.select(F.col("row").alias("unit"), F.col("shard").alias("to")).unionByName(spark.createDataFrame(fits, "unit long, to int"))
    return written(state.join(placed, "unit", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to"), "whole")


def _positions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``start``: the weight before a row within ``keys``, in hash order, by
    1,024 hash ranges, each summed by itself."""
    rows = rows.withColumn("_range", F.pmod(F.xxhash64("row", F.lit(5)), F.lit(RANGES)))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = (rows.groupBy(*keys, "_range").agg(F.sum("weight").alias("_w"))
             .select(*keys, "_range", F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_base")))
    within = (Window.partitionBy(*keys, "_range").orderBy(F.xxhash64("row"), "row")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (rows.join(bases, [*keys, "_range"])
            .withColumn("start", F.col("_base") + F.coalesce(F.sum("weight").over(within), F.lit(0)))
            .drop("_range", "_base"))


def _slot(position: Column, gaps: list[float]) -> Column:
    """The shard whose part of the line of gaps holds the position."""
    edges, at = [], 0.0
    for g in gaps[:-1]:
        at += g
        edges.append(at)
    ends = F.array(*[F.lit(float(e)) for e in edges]) if edges else F.array().cast("array<double>")
    return F.size(F.filter(ends, lambda e: e <= position)).cast("int")


def _fill(loose: DataFrame, gaps: list[float]) -> DataFrame:
    scale = loose.agg(F.sum("weight").alias("w")).first()["w"] or 0
    whole = sum(gaps) or 1.0
    gaps = [g * scale / whole for g in gaps] if sum(gaps) else [scale / len(gaps)] * len(gaps)
    placed = _positions(loose.withColumn("_all", F.lit(0)), ["_all"])
    return placed.select("row", "weight", _slot(F.col("start") + F.col("weight") / 2, gaps).alias("shard"))


def _level(state: DataFrame, shards: int, room: float, tolerance: float) -> tuple[bool, DataFrame]:
    """Move pieces of at most half a shard's surplus from too heavy to too light
    shards, rows without links first."""
    loads = _loads(state, shards)
    surplus = {s: loads[s] - room for s in range(shards) if loads[s] - room > max(1.0, room * tolerance)}
    if not surplus:
        return False, state
    gaps = [max(0.0, room - x) for x in loads]
    line, offsets, at = sum(gaps), [], 0.0
    for s, more in surplus.items():
        offsets.append((s, float(more), at))
        at += more
    givers = state.sparkSession.createDataFrame(offsets, "shard int, surplus double, offset double")
    pieces = (state.join(givers, "shard").groupBy("shard", "piece", "surplus", "offset")
              .agg(F.sum("weight").alias("weight"), F.max("fixed").alias("fixed")).withColumnRenamed("piece", "row"))
    able = written(pieces.where("weight <= surplus / 2"), "able")
    loosely = {r["shard"]: float(r["w"]) for r in able.where("fixed = 0").groupBy("shard").agg(F.sum("weight").alias("w")).collect()}
    free = state.sparkSession.createDataFrame([(s, loosely.get(s, 0.0)) for s in surplus], "shard int, free double")
    moved = (_positions(able, ["shard", "fixed"]).join(free, "shard")
             .withColumn("start", F.col("start") + F.col("fixed") * F.col("free"))
             .where(F.col("start") + F.col("weight") <= F.col("surplus"))
             .select("shard", F.col("row").alias("piece"), _slot((F.col("offset") + F.col("start") + F.col("weight") / 2) * (line / at), gaps).alias("to")))
    after = state.join(moved, ["shard", "piece"], "left").withColumn("shard", F.coalesce("to", "shard")).drop("to")
    return True, written(after, "levelled")


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents in shards of near-equal bytes, copies of a text together.

    A document weighs the UTF-8 bytes of its text (null: none) plus 1; equal
    texts are linked. (Texts that share a 64-bit hash would be linked too, which
    costs nothing but a tie.) Returns ``doc_id, size, text_crc32, shard, slot``;
    ``slot`` counts from 0 without gaps in each shard. Null texts have size 1
    and crc 0 and no links; null ids and repeated rows are kept as rows of their
    own; an empty table gives no rows; other columns are not read.
    """
    text = F.col(text_col)
    base = written(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("text_crc32"),
        F.when(text.isNotNull(), F.xxhash64(text)).alias("link")), "docs")
    placed = propagate(base.select("row", F.col("size").alias("weight"), F.array("link").alias("links")), shards)
    out = written(base.drop("link").join(placed.select("row", "shard"), "row"), "placed")
    order = [F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    return ranked(out, ["shard"], order, "slot").drop("row")
