"""Conversation structure repair by an auction algorithm for shortest paths.

The rows of a conversation, in order, become a lattice: node (i, s) means that i
rows are done and the roles given so far leave the pattern ``(s?(ua)+)?`` in state
s. Keeping, re-roling, deleting and inserting are its arcs, with whole costs.
Every node has a price. From the origin a path is extended along the arc that is
cheapest together with the price at its end; where no arc matches the end node's
price, that price rises to the best arc and the path contracts by a node. When the
path arrives, the origin's price is the least cost, and all cheapest repairs run
over tight arcs (those whose cost is the difference of the prices). The
ASCII-least of them is traced over the tight arcs that lead to the end.

Prices start at what each remaining row costs at least, which keeps them
feasible, so only faults of the order have to be paid for by bids. Conversations
longer than a block are solved in two steps: auctions between the states before
and after a block give its table of costs, tables are combined the same way in
groups, and the prices at the blocks' borders then let each block be traced alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import make_room, small_batches, worker_store, written

SPACE = r"\x20\x09-\x0D"
INITIALS = "sua"
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
BLOCK, FAN, KNOWN = 64, 16, 100_000
STATES = range(4)  # nothing yet, after s, after u, after a
FREE = float("inf")
# What is left to insert after the last row, by state.
TAIL = ("", "II", "I", "")
TAIL_COST = tuple(INSERT * len(t) for t in TAIL)
ROLE = {2: "user", 3: "assistant"}


def turn_state(s: int) -> int:
    """The state after the next user or assistant turn."""
    return 3 if s == 2 else 2


def keep_state(s: int, initial: int) -> int | None:
    """The state after a row with this initial, None if it does not fit."""
    if initial == 0:
        return 1 if s == 0 else None
    return initial + 1 if initial < 3 and turn_state(s) == initial + 1 else None


def row_arcs(code: int) -> list[list[tuple[str, int, int, int]]]:
    """For each state the arcs of a row (initial + 4 * fault), in ASCII order:
    letter, cost, rows done, state after."""
    initial, fault = code % 4, code // 4
    extra = CUT_OFF if fault == TRUNCATED else 0
    out = []
    for s in STATES:
        arcs = [("D", DELETE, 1, s), ("I", INSERT, 0, turn_state(s))]
        if fault in (NONE, TRUNCATED):
            kept = keep_state(s, initial)
            if kept is not None:
                arcs.append(("K", extra, 1, kept))
            arcs.append(("R", REROLE + extra, 1, turn_state(s)))
        out.append(arcs)
    return out


ARCS = [row_arcs(code) for code in range(16)]
CHEAPEST = [min(cost for arcs in by_state for _, cost, rows, _ in arcs if rows) for by_state in ARCS]
END = -1


def auction(arcs: Callable[[int], list[tuple[str, float, int]]], price: list[float], origin: int) -> float:
    """Least cost from ``origin`` to END (price 0), FREE if it is out of reach.
    ``price`` is feasible (no node's is above the cost of an arc plus the price at
    its end), stays so, and ends exact at the origin."""
    path = [origin]
    while path[-1] != END:
        node = path[-1]
        best, to = FREE, END
        for _, cost, target in arcs(node):
            bid = cost + (price[target] if target != END else 0)
            if bid < best:
                best, to = bid, target
        if price[node] < best:
            price[node] = best
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)
    return price[origin]


def block_arcs(codes: bytes, ends: tuple[float, ...]) -> Callable[[int], list[tuple[str, float, int]]]:
    """Arcs of a block of rows; leaving it in state s costs ``ends[s]``."""
    n = len(codes)
    cache: dict[int, list[tuple[str, float, int]]] = {}

    def arcs(node: int) -> list[tuple[str, float, int]]:
        found = cache.get(node)
        if found is None:
            i, s = divmod(node, 4)
            if i == n:
                found = [("", ends[s], END)]
            else:
                found = [(letter, cost, 4 * (i + rows) + to) for letter, cost, rows, to in ARCS[codes[i]][s]]
            cache[node] = found
        return found

    return arcs


def first_prices(codes: bytes, ends: tuple[float, ...]) -> list[float]:
    """Feasible prices: the cheapest arc of every row still to come; FREE in states
    that never lead out of the block (no row leads back from a later state)."""
    dead = [min(ends[s:]) == FREE if s < 2 else min(ends[2:]) == FREE for s in STATES]
    least, price = min(ends), []
    for code in [0, *reversed(codes)]:
        least += CHEAPEST[code] if price else 0
        price += [FREE if dead[s] else least for s in reversed(STATES)]
    return price[::-1]


def reaches(s: int, to: int, codes: bytes) -> bool:
    """Can a block lead from state s to state ``to``?"""
    if to == 0:
        return s == 0
    if to == 1:
        return s == 1 or s == 0 and any(c % 4 == 0 and c // 4 in (NONE, TRUNCATED) for c in codes)
    return True


def block_table(codes: bytes) -> list[list[float]]:
    """Least cost of a block from each state to each state."""
    out = [[FREE] * 4 for _ in STATES]
    for to in STATES:
        ends = tuple(0 if s == to else FREE for s in STATES)
        arcs, price = block_arcs(codes, ends), first_prices(codes, ends)
        for s in STATES:
            if reaches(s, to, codes):
                out[s][to] = auction(arcs, price, s)
    return out


def table_arcs(tables: list[list[list[float]]], ends: tuple[float, ...]) -> Callable[[int], list[tuple[str, float, int]]]:
    """Arcs of a row of blocks."""
    n = len(tables)

    def arcs(node: int) -> list[tuple[str, float, int]]:
        k, s = divmod(node, 4)
        if k == n:
            return [("", ends[s], END)]
        return [("", cost, 4 * (k + 1) + to) for to, cost in enumerate(tables[k][s]) if cost < FREE]

    return arcs


def borders(tables: list[list[list[float]]], ends: tuple[float, ...]) -> list[tuple[float, ...]]:
    """Least cost to the end from each state at the start of each block. Groups of
    blocks come first, so that no auction runs over more than FAN blocks."""
    if len(tables) > FAN:
        groups = [tables[at: at + FAN] for at in range(0, len(tables), FAN)]
        after = [*borders([joined(g) for g in groups], ends)[1:], ends]
        return [b for g, e in zip(groups, after) for b in borders(g, e)]
    price = [0.0] * (4 * len(tables) + 4)
    arcs = table_arcs(tables, ends)
    for node in range(4 * len(tables) + 3, -1, -1):
        auction(arcs, price, node)
    return [tuple(price[4 * k: 4 * k + 4]) for k in range(len(tables))]


def joined(tables: list[list[list[float]]]) -> list[list[float]]:
    """The table of a few blocks in a row."""
    out = [[FREE] * 4 for _ in STATES]
    for to in STATES:
        arcs = table_arcs(tables, tuple(0 if s == to else FREE for s in STATES))
        price = [0.0] * (4 * len(tables) + 4)
        for s in STATES:
            out[s][to] = auction(arcs, price, s)
    return out


def traced(codes: bytes, start: int, ends: tuple[float, ...]) -> tuple[float, str, int]:
    """Least cost of a block from state ``start``, the ASCII-least audit among its
    cheapest, and the state that this leaves."""
    arcs, price = block_arcs(codes, ends), first_prices(codes, ends)
    cost = auction(arcs, price, start)

    def tight(node: int) -> list[tuple[str, int]]:
        return [(a[0], a[2]) for a in arcs(node) if price[node] == a[1] + (price[a[2]] if a[2] != END else 0)]

    leads: dict[int, bool] = {END: True}

    def arrives(node: int) -> bool:
        """Does a path of tight arcs lead from here to the end? Tight arcs have no
        cycle, since a cycle costs something; so depth first, with a stack."""
        stack = [node]
        while stack:
            v = stack[-1]
            if v in leads:
                stack.pop()
                continue
            todo = [w for _, w in tight(v) if w not in leads]
            if todo and not any(leads.get(w) for _, w in tight(v)):
                stack.append(todo[0])
            else:
                leads[v] = any(leads.get(w) for _, w in tight(v))
                stack.pop()
        return leads[node]

    audit, node = [], start
    while node < 4 * len(codes):
        letter, node = next((letter, w) for letter, w in tight(node) if arrives(w))
        audit.append(letter)
    return cost, "".join(audit), node % 4


def solve(blocks: list[bytes], tables: list[list[list[float]] | None]) -> tuple[int, str]:
    """Least cost and ASCII-least cheapest audit of the rows in these blocks."""
    if not blocks:
        return 0, ""
    after = [TAIL_COST]
    if len(blocks) > 1:
        after = [*borders([t or block_table(c) for c, t in zip(blocks, tables)], TAIL_COST)[1:], TAIL_COST]
    total, audit, state = None, [], 0
    for codes, ends in zip(blocks, after):
        cost, letters, state = traced(codes, state, ends)
        total = cost if total is None else total
        audit.append(letters)
    return int(total), "".join(audit) + TAIL[state]


def kept_lines(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Role and text of each turn after the edits of ``audit``."""
    state, at = 0, 0

    def inserted() -> Iterator[tuple[str, str]]:
        nonlocal state, at
        while audit[at: at + 1] == "I":
            state = turn_state(state)
            at += 1
            yield ROLE[state], ""

    for role, text in rows:
        yield from inserted()
        edit = audit[at]
        at += 1
        if edit == "K":
            state = keep_state(state, INITIALS.find(role[:1]))
            yield role, text
        elif edit == "R":
            state = turn_state(state)
            yield ROLE[state], text
    yield from inserted()


def facts_of(rows: DataFrame, gone: Column) -> DataFrame:
    """What a row's own text tells: its place in the order, initial, blank, truncated."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    own = F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256))
    return rows.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), own.alias("own"),
                       F.coalesce(gone, F.lit(False)).alias("gone"))


def order() -> list[Column]:
    """The order of rows: by conversation and turn, nulls first; rows of one turn by
    role and a digest of role and text, so that equal rows stand together."""
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("own")]


CODED = "{id}, part int, seq long, codes binary, costs binary, first_turn long, last_turn long, turns long"
JUDGED = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def coded_blocks(facts: DataFrame) -> DataFrame:
    """Rows -> blocks of codes (initial + 4 * fault), in order. Ranges of the order
    are dealt to the tasks, so a conversation of very many rows is shared out."""
    kind = facts.schema["conv_id"].dataType.simpleString()
    here = facts.where("not gone")
    # Of rows with equal role and text those after the first turn that has them.
    again = here.groupBy("conv_id", "own").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1").select(
        F.col("conv_id").alias("__conv"), F.col("own").alias("__own"), F.col("first.turn").alias("__turn"), F.lit(True).alias("__found"))
    shape = here.select(
        "conv_id", "turn", "role", "own", F.lit(False).alias("gone"), (~F.col("text").rlike(f"[^{SPACE}]")).alias("blank"),
        (~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")).alias("cut"))
    marked = shape.join(again, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("own") == F.col("__own")), "left").select(
        "conv_id", "turn", "role", "own", "gone", "blank", "cut",
        (F.coalesce("__found", F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("__turn"))).alias("late"))
    missing = facts.where("gone").select("conv_id", "turn", "role", "own", "gone", *(F.lit(False).alias(c) for c in ("blank", "cut", "late")))
    dealt = (written(marked.unionByName(missing), "turns").repartitionByRange(*order()).sortWithinPartitions(*order())
             .select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "own", "gone", "blank", "cut", "late", F.spark_partition_id().alias("part")))

    names = ["conv_id", "part", "seq", "codes", "costs", "first_turn", "last_turn", "turns"]
    types = [to_arrow_type(facts.schema["conv_id"].dataType), pa.int32(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 3]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held, last, seq, part = None, None, 0, 0

        def close() -> None:
            nonlocal held, seq
            if held is not None:
                conv, codes, turns = held
                codes = bytes(codes)
                table = None if len(codes) < BLOCK else np.array(block_table(codes), np.float64).tobytes()
                out.append((conv, part, seq, codes, table, turns[0] if turns else None, turns[-1] if turns else None, len(turns)))
                seq += 1
            held = None

        for batch in batches:
            for conv, turn, initial, own, gone, blank, cut, late, part in zip(*(c.to_pylist() for c in batch.columns)):
                if held is None or held[0] != conv or len(held[1]) == BLOCK:
                    close()
                    held = conv, bytearray(), []
                if gone:
                    continue
                repeat, last = (conv, turn, own) == last, (conv, turn, own)
                fault = BLANK if blank else DUPLICATE if late or repeat else TRUNCATED if cut else NONE
                held[1].append(INITIALS.find(initial) % 4 + 4 * fault if initial else 3 + 4 * fault)
                if turn is not None and held[2][-1:] != [turn]:
                    held[2].append(turn)
            if len(out) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return dealt.mapInArrow(code, CODED.format(id=f"conv_id {kind}"))


def judged(facts: DataFrame) -> DataFrame:
    """One row for each conversation: its faults, and the audit of its cheapest
    repair. A task holds two bytes or so for each row of a conversation, as
    much as the conversation's own audit needs."""
    blocks = coded_blocks(facts)
    kind = facts.schema["conv_id"].dataType.simpleString()
    together = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_store("audits")
        out: list[tuple] = []
        for conv, rows in groupby(rows_of(batches), key=lambda r: r[0]):
            blocks, tables, low, high, distinct = [], [], None, None, 0
            for _, _, _, codes, costs, first, last, turns in rows:
                if codes:
                    blocks.append(codes)
                    tables.append(np.frombuffer(costs, np.float64).reshape(4, 4).tolist() if costs else None)
                if turns:
                    distinct += turns - (first == high)
                    low, high = first if low is None else low, last
            whole = b"".join(blocks)
            found = known.get(whole)
            if found is None:
                found = solve(blocks, tables)
                if len(whole) <= BLOCK:
                    make_room(known, KNOWN)
                    known[whole] = found
            codes = np.frombuffer(whole, np.uint8)
            faults = np.bincount(codes // 4, minlength=4).tolist()
            pairs = np.stack([codes[:-1] % 4, codes[1:] % 4])
            legal = int(((pairs[0] < 3) & (pairs[1] == np.where(pairs[0] == 1, 2, 1))).sum())
            out.append((conv, high - low + 1 - distinct if distinct else 0, *faults[1:], len(codes[1:]) - legal, *found))
            if len(out) >= 4096:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    id_type = to_arrow_type(facts.schema["conv_id"].dataType)
    names = ["conv_id", *(c.split()[0] for c in JUDGED.split(", "))]
    types = [id_type, *[pa.int64()] * 6, pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return together.mapInArrow(judge, f"conv_id {kind}, {JUDGED}")


def repair_conversations(conversations: DataFrame, gone: Column | None = None) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256`` for every conversation among rows ``conv_id, turn, role, text``.

    Rows stand by turn (nulls first), rows of one turn by role and then a digest.
    A row's first fault counts: blank, duplicate (role and text of an earlier
    row), truncated. The digest is that of the repaired rows ``role:text``, joined
    by line ends. Rows where ``gone`` holds only name their conversation; without
    others it has zeros, an empty audit and the digest of an empty text. Null
    roles and texts are one blank; a null conv_id is a conversation of its own; an
    empty table gives no rows; other columns are not read.
    The digest runs over a conversation in order, so one task reads its texts
    in a stream and holds none of them.
    """
    return _walked(conversations, gone, lines=False)


def repaired_rows(conversations: DataFrame, gone: Column | None = None) -> DataFrame:
    """The repaired conversations themselves: ``conv_id, place`` (from 0), ``role,
    text``. What ``repair_conversations`` says of odd rows holds here too."""
    return _walked(conversations, gone, lines=True)


def _walked(conversations: DataFrame, gone: Column | None, lines: bool) -> DataFrame:
    small_batches(conversations.sparkSession)
    facts = facts_of(conversations, F.lit(False) if gone is None else gone)
    verdicts = written(judged(facts), "audits")
    kind = facts.schema["conv_id"].dataType.simpleString()
    says = [c.split()[0] for c in JUDGED.split(", ")]
    heads = verdicts.select("conv_id", F.lit(0).alias("kind"), *(F.lit(None).cast(t).alias(c) for c, t in
                            (("turn", "long"), ("role", "string"), ("text", "string"), ("own", "binary"))), *says)
    texts = facts.where("not gone").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "own", *(
        F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in JUDGED.split(", ")))
    conv, *rest = order()
    stream = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions(conv, "kind", *rest).select("conv_id", "kind", "role", "text", *says)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        out: list[tuple] = []
        for conv_id, own in groupby(rows(), key=lambda r: r[0]):
            head = next(own)[4:]
            made, digest = 0, hashlib.sha256()
            for role, text in kept_lines(head[-1], (r[2:4] for r in own)):
                if lines:
                    out.append((conv_id, made, role, text))
                else:
                    digest.update(f"{chr(10) if made else ''}{role}:{text}".encode())
                made += 1
                if len(out) >= 512:
                    yield made_of(out)
                    out = []
            if not lines:
                out.append((conv_id, *head, digest.hexdigest()))
                if len(out) >= 4096:
                    yield made_of(out)
                    out = []
        if out:
            yield made_of(out)

    id_type = to_arrow_type(facts.schema["conv_id"].dataType)
    types = [id_type, pa.int64(), pa.string(), pa.string()] if lines else [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
    names = ["conv_id", "place", "role", "text"] if lines else ["conv_id", *says, "repaired_sha256"]

    def made_of(some: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], names)

    return stream.mapInArrow(walk, f"conv_id {kind}, place long, role string, text string" if lines else
                             f"conv_id {kind}, {JUDGED}, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by a checksum of their place; ``gone`` marks dropped ones. Null
    roles and texts, and null ids and turns in the place's name, are one blank."""
    def named(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(named("text"), "[.!?]", "")).otherwise(named("text"))
    times = F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.select("conv_id", "turn", F.when(hit == 4, "user").otherwise(named("role")).alias("role"), text.alias("text"),
                                (hit == 0).alias("gone"), F.explode(times).alias("copy")).drop("copy")


# The same rules in DuckDB: every state's best (cost, audit, text) is carried from
# row to row. The checksum is computed bit by bit.
def _edit(state: str, letter: str, cost: str, line: str = "") -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {line or chr(39) * 2}}}"


def _opened(rows: str) -> str:
    """States 2 and 3 after insertions, beside the row's own columns."""
    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    best = ", ".join(["s2", *(_edit(s, "I", str(INSERT), user) for s in ("s0", "s1", "s3"))])
    return (f"SELECT *, list_min([s3, {_edit('y2', 'I', str(INSERT), assistant)}]) AS y3 "
            f"FROM (SELECT *, list_min([{best}]) AS y2 FROM {rows})")


def _oracle() -> str:
    crc = ("xor(list_reduce(list_transform(string_split(k, ''), lambda x: CAST(ord(x) AS BIGINT)), "
           "lambda c, b: list_reduce(range(8), lambda v, j: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(c, b)), 4294967295), 4294967295)")
    far = "{'c': 1000000, 'a': '', 't': ''}"
    cut = f"CASE fault WHEN {TRUNCATED} THEN {CUT_OFF} ELSE 0 END"
    own = "chr(10) || role || ':' || text"

    def step(to: str, froms: list[str], initial: str | None, rerole: str | None, same: str) -> str:
        ways = [_edit(same, "D", str(DELETE))]
        for f in froms:
            if initial:
                ways.append(f"CASE WHEN x = '{initial}' AND fault IN (0, 3) THEN {_edit(f, 'K', cut, own)} ELSE {far} END")
            if rerole:
                ways.append(f"CASE WHEN fault IN (0, 3) THEN {_edit(f, 'R', f'{REROLE} + {cut}', f'chr(10) || {chr(39)}{rerole}:{chr(39)} || text')} ELSE {far} END")
        return f"list_min([{', '.join(ways)}]) AS {to}"

    moves = ", ".join([step("s0", [], None, None, "s0"), step("s1", ["s0"], "s", None, "s1"),
                       step("s2", ["s0", "s1", "y3"], "u", "user", "y2"), step("s3", ["y2"], "a", "assistant", "y3")])
    rows = "(SELECT p.*, f.x, f.fault, f.role, f.text FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1)"
    return rf"""
WITH RECURSIVE k AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS hit FROM k),
d AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
             CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE hit <> 0),
i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM i),
f AS (SELECT *, left(role, 1) AS x, CASE WHEN NOT regexp_matches(text, '[^{SPACE}]') THEN 1 WHEN nth > 1 THEN 2
             WHEN NOT regexp_matches(text, '[.!?][{SPACE}]*$') THEN 3 ELSE 0 END AS fault FROM o),
p AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {{'c': 0, 'a': '', 't': ''}} AS s0, {far} AS s1, {far} AS s2, {far} AS s3 FROM conversations
      UNION ALL SELECT conv_id, i + 1 AS i, {moves} FROM ({_opened(rows)})),
e AS (SELECT conv_id, list_min([s0, y3]) AS best FROM ({_opened("(SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)")})),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
             count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
             count(*) FILTER (i > 1 AND (coalesce(before, '') || x) NOT IN ('su', 'ua', 'au')) AS illegal
      FROM (SELECT *, lag(x) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM f) GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(best.c AS BIGINT) AS cost, best.a AS audit,
       sha256(substr(best.t, 2)) AS repaired_sha256
FROM e LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM e.conv_id
"""


ORACLE = _oracle()
