"""Conversation repair against exhaustive search and plain rules."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from broadsheet.llm import repair

EMPTY = hashlib.sha256(b"").hexdigest()
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(codes):
    """Cheapest, then ASCII-least audit, by every pair of state and row."""
    def opened(best):
        for _ in range(2):
            for s, (c, a) in list(best.items()):
                t = repair.turn_state(s)
                best[t] = min(best.get(t, (10 ** 9, "")), (c + 5, a + "I"))
        return best
    best = {0: (0, "")}
    for code in codes:
        initial, fault = code % 4, code // 4
        after = {}

        def offer(s, value):
            after[s] = min(after.get(s, (10 ** 9, "")), value)

        for s, (c, a) in opened(best).items():
            offer(s, (c + 2, a + "D"))
            if fault in (0, 3):
                extra = 5 if fault else 0
                offer(repair.turn_state(s), (c + 1 + extra, a + "R"))
                to = 1 if initial == 0 and s == 0 else initial + 1 if initial in (1, 2) and repair.turn_state(s) == initial + 1 else None
                if to:
                    offer(to, (c + extra, a + "K"))
        best = after
    return min(v for s, v in opened(best).items() if s in (0, 3))


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=40), st.sampled_from([2, 5, 64]))
def test_auction_finds_the_least_audit(raw, size):
    codes = bytes(b % 16 for b in raw)
    blocks = [codes[i: i + size] for i in range(0, len(codes), size)]
    assert repair.solve(blocks, [None] * len(blocks)) == plain(codes)


def test_long_conversations_in_blocks():
    codes = bytes((7 * k * k + k // 3) % 16 for k in range(3000))
    blocks = [codes[i: i + 64] for i in range(0, len(codes), 64)]
    assert repair.solve(blocks, [repair.block_table(b) for b in blocks]) == plain(codes)


def judge(rows):
    """The contract's rules in a loop; rows in order."""
    seen, codes = set(), []
    for role, text in rows:
        fault = 0 if re.search(r"[^\x20\x09-\x0D]", text) else 1
        if not fault and (role, text) in seen:
            fault = 2
        if not fault and not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text):
            fault = 3
        seen.add((role, text))
        codes.append("sua".find(role[:1]) % 4 + 4 * fault if role else 3 + 4 * fault)
    cost, audit = plain(codes)
    out, state, k = [], 0, 0
    for edit in audit:
        if edit == "I":
            state = repair.turn_state(state)
            out.append(("user" if state == 2 else "assistant") + ":")
            continue
        role, text = rows[k]
        k += 1
        if edit == "K":
            state = "sua".index(role[0]) + 1
            out.append(f"{role}:{text}")
        elif edit == "R":
            state = repair.turn_state(state)
            out.append(("user" if state == 2 else "assistant") + f":{text}")
    pairs = [(a[:1] + b[:1]) for (a, _), (b, _) in zip(rows, rows[1:])]
    faults = [c // 4 for c in codes]
    return (faults.count(1), faults.count(2), faults.count(3), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


CASES = {
    1: [(0, "user", "Hi."), (1, "assistant", "Yes."), (2, "user", "Hi."), (3, "assistant", "Yes.")],
    2: [(0, "system", "Be."), (3, "assistant", "No end"), (7, "user", " \t")],
    3: [(None, "user", "Null turn."), (None, None, "Null role."), (4, "assistant", None)],
    4: [(0, "tool", "Odd."), (1, "", "None."), (2, "User", "Upper!")],
    5: [(0, "assistant", "x" * 60_000 + ".\n"), (0, "assistant", "x" * 60_000 + ".\n")],
    6: [(k, "user" if k % 3 else "assistant", f"Turn {k}{'.' if k % 7 else ''}") for k in range(400)],
    None: [(0, "user", "No id."), (1, "assistant", "\x1c")],
}


def test_operator_equals_plain_rules(spark):
    rows = [(c, t, r, x) for c, turns in CASES.items() for t, r, x in turns]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5, "text").withColumn("gone", F.lit("clash")).withColumn("cost", F.lit(9))
    got = {r.conv_id: r for r in repair.repair_conversations(df).collect()}
    assert set(got) == set(CASES)
    for c, turns in CASES.items():
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        in_order = [(" " if r is None else r, " " if x is None else x) for _, r, x in sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or " "))]
        assert tuple(got[c])[1:] == (gaps, *judge(in_order)), c


def test_repaired_rows_are_the_hashed_ones(spark):
    df = spark.createDataFrame([(c, t, r, x) for c, turns in CASES.items() for t, r, x in turns], SCHEMA)
    lines = repair.repaired_rows(df).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(":", "role", "text")))).alias("l"))
    by_rows = {r[0]: r[1] for r in lines.select("conv_id", F.sha2(F.array_join(F.col("l.col2"), "\n"), 256)).collect()}
    hashed = {r.conv_id: r.repaired_sha256 for r in repair.repair_conversations(df).collect()}
    assert all(hashed[c] == by_rows.get(c, EMPTY) for c in hashed)


def test_dropped_rows_name_their_conversation(spark):
    df = spark.createDataFrame([(1, 0, "user", "Gone.")], SCHEMA)
    assert repair.repair_conversations(df, F.lit(True)).collect() == [(1, 0, 0, 0, 0, 0, 0, "", EMPTY)]
    assert repair.repair_conversations(df.limit(0)).collect() == []
    assert repair.repair_conversations(repair.damaged(df.limit(0)), F.col("gone")).collect() == []


def test_text_ids(spark):
    df = spark.createDataFrame([("a", 0, "user", "Hi."), ("a", 1, "assistant", "Ho.")], "conv_id string, turn int, role string, text string")
    assert [(r.conv_id, r.cost, r.audit) for r in repair.repair_conversations(df).collect()] == [("a", 0, "KK")]


def test_damage_follows_the_checksum(spark):
    import zlib
    rows = [(c, t, "assistant", "A. b?") for c in range(40) for t in (0, 1)] + [(None, None, None, None)]
    got = repair.damaged(spark.createDataFrame(rows, SCHEMA)).collect()
    expect = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        expect += [(c, t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text, k == 0)] * (2 if k == 3 else 1)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expect))
