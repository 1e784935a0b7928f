"""Best-fit packing by length patterns fitted with non-negative least squares.

Documents become pieces of at most ``capacity`` tokens. All patterns of two or
three pieces that fill a sequence exactly are enumerated over the lengths that
occur; their repeat counts are fitted to the length histogram by non-negative
least squares (multiplicative updates), rounded, and cut to what the histogram
holds. What is left is packed by best fit, longest first, on the histogram, with
counts instead of single pieces. So the driver sees the histogram only, at most
``capacity`` numbers. Pieces of a length are numbered by a distributed rank, and
the number gives the sequence and the place in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Chunks, ranked, small_batches, worker_store, written

CAPACITY = 2048
END_ID = 0
ROUNDS = 200
PIECES = "{id} {kind}, piece int, start long, length int, ids binary"
# Letters, and signs, that the vocabulary's own rules leave whole: no split, no composition.
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[!-&(-/:-@\[-`{-~]+")
CHUNKS = 500_000


def byte_letters() -> dict[int, str]:
    """Byte -> the printable letter that stands for it in a byte-level vocabulary:
    printable Latin-1 bytes stand for themselves, the rest count up from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Text -> token ids (little-endian unsigned 32-bit), as the tokenizer gives
    them. A vocabulary with word ends drops white space and never merges across it, so the
    ids of a text are those of its chunks; chunks are remembered in a bounded table, and
    a batch looks each distinct chunk up once. Texts with control characters that only Python takes
    for white space, or with the tokenizer's own strings, go to the tokenizer whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = byte_letters()
        self.chunks = Chunks(self.chunk, CHUNKS)
        names = [re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self.odd = "|".join(["[\x1c-\x1f]", *names])
        self.by_chunk = getattr(self.model, "end_of_word_suffix", None) == "</w>"

    def plain(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def chunk(self, chunk: str) -> bytes:
        if not PLAIN.fullmatch(chunk):
            return self.plain(chunk)
        low = chunk.lower()
        letters = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(letters)], "<u4").tobytes()

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; null: none."""
        if not self.by_chunk:
            return [self.plain(t) if t else b"" for t in texts.to_pylist()]
        odd = pc.indices_nonzero(pc.match_substring_regex(texts, self.odd)).to_pylist()
        whole = {k: self.plain(texts[k].as_py()) for k in odd}
        if odd:
            texts = pa.array([None if k in whole else t for k, t in enumerate(texts.to_pylist())], texts.type)
        data, at = self.chunks(texts)
        return [whole[k] if k in whole else bytes(data[a:b]) for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist()))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents -> pieces: ids of the text (null: empty) and the end id, cut every
    ``capacity`` ids. A document has at least one piece."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = worker_store("encoders")
        encode = store.get(tokenizer) or store.setdefault(tokenizer, Encoder(tokenizer))
        for batch in batches:
            rows, out = [], []
            for row, ids in enumerate(encode(batch.column(1))):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    rows.append(row)
                    out.append((k, at // 4, min(capacity, (len(ids) - at) // 4), ids[at: at + 4 * capacity]))
            piece, start, length, part = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int32()), pa.array(part, pa.binary())], [id_col, "piece", "start", "length", "ids"])

    return docs.select(id_col, text_col).mapInArrow(cut, PIECES.format(id=f"`{id_col}`", kind=kind))


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All pairs and triples of these lengths, descending, that sum to the
    capacity; a pair has 0 in third place."""
    has = np.zeros(capacity + 1, bool)
    has[lengths] = True
    out = []
    for a in lengths[::-1]:
        b = lengths[(lengths <= a) & (lengths >= -(-(capacity - a) // 2)) & (lengths <= capacity - a)]
        c = capacity - a - b
        fit = (c == 0) | has[c]
        out.append(np.stack([np.full(fit.sum(), a), b[fit], c[fit]], 1))
    return np.concatenate(out) if out else np.zeros((0, 3), int)


def fit(pat: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that bring the pieces they use close to
    ``counts`` (by length) in least squares; ``x *= A'b / A'Ax`` never leaves x >= 0
    and never makes the fit worse."""
    b = counts.astype(float)
    b[0] = 0

    def used(x):
        r = sum(np.bincount(pat[:, j], x, len(b)) for j in range(3))
        r[0] = 0
        return r

    def pull(r):
        return r[pat[:, 0]] + r[pat[:, 1]] + r[pat[:, 2]]

    goal, x = pull(b), np.full(len(pat), max(1.0, b.sum() / (3 * max(1, len(pat)))))
    for _ in range(rounds):
        x *= goal / np.maximum(pull(used(x)), 1e-9)
    return x


def plan(counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[int, list[tuple[int, int]]]]:
    """``counts[length]`` -> [(sequences, [(length, pieces of it in each), ...])]."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[int, list[tuple[int, int]]]] = []
    if left[capacity]:
        out.append((int(left[capacity]), [(capacity, 1)]))
        left[capacity] = 0
    lengths = np.flatnonzero(left)
    pat = patterns(lengths, capacity)
    if len(pat):
        x = fit(pat, left, rounds)
        for k in np.argsort(-x, kind="stable"):
            n = int(np.rint(x[k]))
            if n < 1:
                break
            runs = [(int(v), int((pat[k] == v).sum())) for v in dict.fromkeys(pat[k].tolist()) if v]
            n = min(n, *(int(left[v]) // t for v, t in runs))
            if n > 0:
                out.append((n, runs))
                for v, t in runs:
                    left[v] -= n * t
    return out + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit, longest first, on counts: sequences with equal contents are one
    entry with a number, kept by the space they have left."""
    spaces: dict[int, list[list]] = {capacity: []}
    open_at = np.zeros(capacity + 1, bool)
    for v in np.flatnonzero(left)[::-1].tolist():
        need = int(left[v])
        while need:
            room = v + int(np.argmax(open_at[v:])) if open_at[v:].any() else 0
            if room:
                n, runs = spaces[room].pop()
                open_at[room] = bool(spaces[room])
            else:
                room, n, runs = capacity, -(-need // (capacity // v)), []
            each = min(room // v, need)
            full = min(n, need // each)
            if full < n:  # the others stay as they are
                if runs:
                    spaces.setdefault(room, []).append([n - full, runs])
                    open_at[room] = True
            need -= full * each
            spaces.setdefault(room - each * v, []).append([full, [*runs, (v, each)]])
            open_at[room - each * v] = room > each * v
    return [(n, runs) for group in spaces.values() for n, runs in group]


def ranges(made: list[tuple[int, list[tuple[int, int]]]]) -> tuple[np.ndarray, ...]:
    """The plan as ranges of piece numbers, sorted by (length, first number):
    key, pieces of the length in a sequence, first sequence, first offset."""
    given: dict[int, int] = {}
    rows, sequence = [], 0
    for n, runs in made:
        offset = 0
        for v, t in runs:
            first = given.get(v, 0)
            rows.append(((v << 48) + first, t, sequence, offset))
            given[v] = first + n * t
            offset += v * t
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return tuple(np.ascontiguousarray(table[:, j]) for j in range(4))


def pack(cut: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS, id_col: str = "doc_id") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a written table of pieces. Pieces of
    one length that tie are told apart by id, piece and content; equal ones may
    swap places. At most one range for each pattern and length goes to the tasks:
    fewer than capacity squared / 4, however many pieces there are."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[r["length"]] = r["n"]
    key, times, first_sequence, first_offset = ranges(plan(counts, capacity, rounds))

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        at = (length.to_numpy(np.int64) << 48) + number.to_numpy(np.int64)
        k = np.searchsorted(key, at, "right") - 1
        j = at - key[k]
        return pd.DataFrame({"sequence_id": first_sequence[k] + j // times[k],
                             "offset": first_offset[k] + j % times[k] * length.to_numpy(np.int64)})

    order = [F.col(id_col), F.col("piece"), F.crc32("ids")]
    out = ranked(cut, ["length"], order, "__number").withColumn("__place", place("length", "__number"))
    return out.select(*cut.columns, "__place.sequence_id", "__place.offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents packed into sequences of at most ``capacity`` tokens.

    Returns for each piece ``doc_id, piece, start, length, ids`` (little-endian
    unsigned 32-bit token ids), ``sequence_id, offset``. A null or empty text is
    the end id alone. Only documents of more than ``capacity`` ids are cut. Null
    ids and repeated rows stay rows of their own; an empty table gives no rows;
    other columns are not read.
    """
    return pack(written(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces", "zstd"), capacity, id_col=id_col)
