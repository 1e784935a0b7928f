"""Periodic runs of words, found by enumerating maximal pairs.

A run of period q is a stretch whose words q apart are the same and that no
neighbour extends. Its start i and i + q begin two equal stretches that neither
the word before nor the word after extends: a maximal pair, whose common length
is the run's length less q. The other way round, a maximal pair at a distance
of at most half its length is a run. So runs are read off the pairs and nothing
is extended.

Suffixes of a text are sorted by prefix doubling, the texts of a batch together.
Where neighbouring suffixes share enough words, the LCP-interval tree is walked
bottom-up. An interval holds its positions in order, and by the class of the
word to the left; when two children meet, the smaller one's positions look up
those of the larger one within half the interval's length, skipping whole blocks
of their own class. Positions that close to each other repeat with one period, so
only the first of them can have another class, and few look-ups are in vain.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

LEAST, TIMES = 24, 3
# Words of texts that are sorted together.
TOGETHER = 1 << 17
RUN = "array<struct<start: long, length: long, period: long>>"


def sorted_repeats(codes: np.ndarray, doc: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose next ``depth`` words occur again in their text, in the order
    of (text, suffix), and the number of each one's group of equal ``depth`` words.

    Ranks are numbers of smaller suffixes; every round refines only the groups
    that are still tied, twice as far as the round before."""
    n = len(codes)
    end = np.searchsorted(doc, doc, "right")
    by = np.lexsort((codes, doc))
    new = np.ones(n, bool)
    new[1:] = (np.diff(doc[by]) != 0) | (np.diff(codes[by]) != 0)
    rank = np.empty(n, np.int64)
    rank[by] = np.flatnonzero(new)[np.cumsum(new) - 1]
    group = None
    far = 1

    def tied() -> np.ndarray:
        return np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)

    live = tied()
    while len(live):
        if far >= depth and group is None:
            group = rank.copy()
            some = live
        step = min(far, depth - far) if far < depth else far
        ahead = live + step
        after = np.full(len(live), -1, np.int64)
        inside = ahead < end[live]
        after[inside] = rank[ahead[inside]]
        order = np.lexsort((after, rank[live]))
        at, after, first = live[order], after[order], rank[live[order]]
        head = np.ones(len(at), bool)
        head[1:] = first[1:] != first[:-1]
        part = head.copy()
        part[1:] |= after[1:] != after[:-1]
        place = np.arange(len(at))
        rank[at] = first + np.maximum.accumulate(np.where(part, place, 0)) - np.maximum.accumulate(np.where(head, place, 0))
        far += step
        live = tied()
    if group is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    some = some[np.argsort(rank[some], kind="stable")]
    return some, group[some]


def common_lengths(words: list[int], ends: list[int], at: list[int], group: list[int], depth: int) -> list[int]:
    """Words that each sorted position shares with the one before it; 0 where a
    group begins. In text order a length falls by at most one from word to word."""
    before = {i: j for k, (i, j) in enumerate(zip(at[1:], at)) if group[k + 1] == group[k]}
    shared, last, found = 0, -2, {}
    for i in sorted(before):
        j, end = before[i], ends[i]
        shared = max(depth, shared - 1) if last == i - 1 else depth
        stop = end - max(i, j)
        while shared < stop and words[i + shared] == words[j + shared]:
            shared += 1
        found[i], last = shared, i
    return [found.get(i, 0) for i in at]


class Positions:
    """Positions of an interval: sorted, and sorted within each left-word class."""

    __slots__ = ("all", "by")

    def __init__(self, i: int, left: list[int]):
        self.all, self.by = [i], {left[i]: [i]}

    def others(self, i: int, own: int, reach: int) -> Iterator[int]:
        """Positions of other classes than ``own`` at most ``reach`` away from i."""
        every, same = self.all, self.by.get(own, ())
        if len(same) == len(every):
            return
        t = bisect_right(every, i)
        while t < len(every) and every[t] - i <= reach:
            u = bisect_left(same, every[t])
            if u == len(same) or same[u] != every[t]:
                yield every[t]
                t += 1
            else:
                t += block(every, t, same, u, 1)
        t = bisect_left(every, i) - 1
        while t >= 0 and i - every[t] <= reach:
            u = bisect_right(same, every[t]) - 1
            if u < 0 or same[u] != every[t]:
                yield every[t]
                t -= 1
            else:
                t -= block(every, t, same, u, -1)

    def take(self, small: Positions) -> None:
        add(self.all, small.all)
        for c, at in small.by.items():
            add(self.by.setdefault(c, []), at)


def add(into: list[int], some: list[int]) -> None:
    if not into or some[0] > into[-1]:
        into += some
    else:
        for i in some:
            insort(into, i)


def block(every: list[int], t: int, same: list[int], u: int, way: int) -> int:
    """How many positions from ``every[t]`` on, in this direction, are of the class
    ``same`` (``every[t]`` is ``same[u]``): doubling steps, then halving ones."""
    most = min(len(every) - t, len(same) - u) if way > 0 else min(t, u) + 1
    good, step = 0, 1
    while good + step < most and every[t + way * (good + step)] == same[u + way * (good + step)]:
        good += step
        step *= 2
    while step:
        if good + step < most and every[t + way * (good + step)] == same[u + way * (good + step)]:
            good += step
        step //= 2
    return good + 1


def runs_of(at: list[int], shared: list[int], left: list[int], least: int, times: int) -> dict[tuple[int, int], int]:
    """(start, end) -> smallest period, for the sorted positions and common lengths of
    whole groups."""
    found: dict[tuple[int, int], int] = {}

    def merge(a: Positions, b: Positions, length: int) -> Positions:
        small, large = (a, b) if len(a.all) < len(b.all) else (b, a)
        reach = length // (times - 1)
        for i in small.all:
            for j in large.others(i, left[i], reach):
                start, period = min(i, j), abs(i - j)
                if period + length >= least:
                    key = start, start + period + length
                    if found.get(key, period) >= period:
                        found[key] = period
        large.take(small)
        return large

    open_: list[tuple[int, Positions]] = []
    last = None
    for k in range(len(at) + 1):
        length = shared[k] if k < len(at) else 0
        if last is not None:
            while open_ and open_[-1][0] > length:
                deep, held = open_.pop()
                last = merge(held, last, deep)
            if length:
                if open_ and open_[-1][0] == length:
                    last = merge(open_.pop()[1], last, length)
                open_.append((length, last))
        if k < len(at):
            last = Positions(at[k], left)
    return found


def runs_of_texts(texts: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """Words of each text -> its runs (start, length, period), by start, then period."""
    # A pair of a run of length n and period q has n - q words: at least this many.
    depth = max(1, -(-least * (times - 1) // times))
    known: dict[bytes, int] = {}
    codes = np.array([known.setdefault(w, len(known)) for words in texts for w in words], np.int64)
    sizes = np.array([len(words) for words in texts], np.int64)
    doc, starts = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    at, group = sorted_repeats(codes, doc, depth)
    if not len(at):
        return out
    of = doc[at]
    for d in np.unique(of):
        mine = slice(*np.searchsorted(of, [d, d + 1]))
        first, words = int(starts[d]), codes[starts[d]: starts[d] + sizes[d]].tolist()
        own, ends = (at[mine] - first).tolist(), _Same(len(words))
        shared = common_lengths(words, ends, own, group[mine].tolist(), depth)
        found = runs_of(own, shared, [-1, *words[:-1]], least, times)
        out[int(d)] = sorted((s, e - s, q) for (s, e), q in found.items())
    return out


class _Same:
    """A list that holds one number everywhere."""

    def __init__(self, value: int):
        self.value = value

    def __getitem__(self, _: int) -> int:
        return self.value


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by blanks."""
    if not runs:
        return b" ".join(words)
    cover = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0)])


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, runs, collapsed`` for every row.

    ``runs`` are the stretches (``start, length, period``: numbers of words, from 0)
    of at least ``least`` words and ``times`` (2 or more) smallest periods that no
    neighbouring word extends, by start, then period. ``collapsed`` is the text
    without the words that a run holds after its first period, joined by single
    blanks. Words are runs without ASCII white space, as they are written. Null
    and empty texts have no words, no runs and collapse to an empty text; null ids
    and repeated rows stay rows of their own; an empty table gives no rows; other
    columns are not read. No shuffle: a task holds a batch's texts and the
    suffixes of some of them, or of one very long one.
    """
    if times < 2:
        raise ValueError("a run has two periods at least")
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(texts):
                held, size, begin = [], 0, at
                while at < len(texts) and (not held or size < TOGETHER):
                    text = texts[at].as_py()
                    held.append(text.encode().split() if text else [])
                    size += len(held[-1])
                    at += 1
                runs = runs_of_texts(held, least, times)
                plain = [collapsed(w, r).decode() for w, r in zip(held, runs)]
                rows = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
                yield pa.RecordBatch.from_arrays([ids.slice(begin, at - begin), pa.array(rows, span), pa.array(plain, pa.string())],
                                                 [id_col, "runs", "collapsed"])

    return docs.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInArrow(scan, f"`{id_col}` {kind}, runs {RUN}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the largest length / period, compared exactly; ties go to the
    smaller start, then period. Null if there is none."""
    def order(a: Column, b: Column) -> Column:
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        return (F.when(left > right, -1).when(left < right, 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
                .when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0))
    return F.get(F.array_sort(runs, order), 0)


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every tenth document (by a checksum of its id) turned periodic from some word
    on, as ``id, text``. Null ids are left alone."""
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    with_words = docs.select(id_col, text_col, h.alias("__h"), g.alias("__g"), F.when(h % 10 == 0, words).alias("__w"))
    n = F.size("__w").cast("long")
    a = F.col("__g") % n
    p = 1 + F.floor((n - a) / (3 + F.col("__g") % 8)).cast("long")
    with_rule = with_words.select(id_col, text_col, "__w", n.alias("__n"), F.when(n > 0, a).alias("__a"), F.when(n > 0, p).alias("__p"))
    again = F.transform(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1), lambda i: F.get(
        F.col("__w"), F.when(i < F.col("__a"), i).otherwise(F.col("__a") + (i - F.col("__a")) % F.col("__p")).cast("int")))
    return with_rule.select(id_col, F.when(F.col("__w").isNotNull() & (F.col("__n") > 0), F.array_join(again, " ")).otherwise(F.col(text_col)).alias(text_col))
