from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from broadsheet.llm import packing

from .conftest import table

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, docs, capacity):
    tok = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t in docs:
        ids = np.array([*(tok.encode(t, add_special_tokens=False).ids if t else []), 0], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at: at + capacity]
            want[i, k, at, len(part), part.tobytes()] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in places.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), -(-sum(r["length"] for r in rows) // capacity)


def test_documents_are_packed_tightly_and_whole(spark):
    docs = table(spark, "documents").select("doc_id", "text")
    used, least = check(packing.pack_documents(docs, PATH).collect(), [tuple(r) for r in docs.collect()], 2048)
    assert used <= 1.05 * least + 1


def test_odd_rows_and_empty_table(spark, odd_docs, no_docs):
    given = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    check(packing.pack_documents(odd_docs, PATH, capacity=64).collect(), given, 64)
    assert packing.pack_documents(no_docs, PATH).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_plan_packs_a_histogram_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(5, 1.1, 60_000).astype(int), 1, 2048)
    counts = np.bincount(lengths, minlength=2049)
    made = packing.plan(counts)
    used = np.zeros(2049, int)
    for n, runs in made:
        assert n > 0 and sum(v * t for v, t in runs) <= 2048
        for v, t in runs:
            used[v] += n * t
    assert (used == counts).all()
    assert sum(n for n, _ in made) <= 1.003 * (lengths.sum() / 2048) + 2


def test_ranges_number_every_piece_once():
    made = [(3, [(5, 2), (2, 1)]), (2, [(5, 1)])]
    key, times, sequence, offset = packing.ranges(made)
    got = set()
    for length, n in ((5, 8), (2, 3)):
        for k in range(n):
            i = np.searchsorted(key, (length << 48) + k, "right") - 1
            j = (length << 48) + k - key[i]
            got.add((int(sequence[i] + j // times[i]), int(offset[i] + j % times[i] * length)))
    assert len(got) == 11 and (0, 10) in got and (4, 0) in got


def test_encoder_gives_the_tokenizers_ids_and_looks_a_word_up_once():
    tok = Tokenizer.from_file(PATH)
    texts = ["Don't, 'tis  (a) b,c d... É, naïve_x_; x2, 3.5% ' ,'s it's, ÀÉ!!", "<|endoftext|>, a<|endoftext|> b <|startoftext|>,", "a\x1cb, c\x85d\xa0e, f.",
             "é, H̱, K̸≮ İ. ß, Σας.", "日本, 語. привет!", "", None, "  \n\t ", "end,", "word word, word. WORD! word\tword?\nword;"]
    encode = packing.Encoder(PATH)
    got = encode(pa.array(texts).slice(1)) + encode(pa.array(texts[:1]))
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts[1:] + texts[:1]]
    seen = []
    encode.chunks.made = lambda c: seen.append(c) or b"1234"
    data, at = encode.chunks(pa.array(["zyxw zyxw, zyxw.", "zyxw; zyxw, other"]))
    assert sorted(seen) == sorted({"zyxw", "other"} | {s for s in seen if not s.isalpha()}) and at.tolist() == [0, at[1], at[2]] and at[2] == len(data)
