import base64
import contextlib
import gzip
import hashlib
import io
import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from broadsheet.llm import chat, urls, warc

from .conftest import table


def sha(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def records(pages):
    """What the archive should say of (id, payload) rows."""
    first = {}
    for i, p in pages:
        if i is not None:
            first[p] = min(i, first.get(p, i))
    return Counter((i, len(p), sha(p), "response" if i == first.get(p, i) else "revisit", None if i == first.get(p, i) else first[p]) for i, p in pages)


def read(df):
    return Counter(tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


def test_pages_survive_the_archive_in_small_ranges(spark):
    pages = table(spark, "pages")
    given = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    path = warc.write_warc(pages, chunk_bytes=20_000)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700", "5000", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = warc.read_warc(spark, path)
            assert read(df) == records(given)
        assert {(r["page_id"], bytes(r["payload"])) for r in df.where("record_type = 'response'").collect()} <= set(given)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_odd_pages_and_magic_bytes_inside_members(spark):
    rng = random.Random(4)
    noise = "".join(chr(rng.randrange(32, 0x2FF)) for _ in range(4000))
    rows = [(1, "http://a/\r\nWARC-Type: x", "same", 1), (1, "http://a/", "same", 1), (2, None, "same", 1), (3, "u", None, 1), (4, "u", "", 1),
            (None, "u", "same", 1), (None, "u", "alone", 1), (5, "é ", noise, 1), (6, "u", "y" * 300_000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest int")
    path = warc.write_warc(df, chunk_bytes=3000)
    assert read(warc.read_warc(spark, path)) == records([(i, (h or "").encode()) for i, _, h, _ in rows])
    empty = warc.write_warc(df.limit(0))
    assert warc.read_warc(spark, empty).collect() == []


def test_stored_members_with_false_magic_are_joined_over_ranges(spark, tmp_path):
    """Uncompressed members that hold the magic bytes of a gzip member, cut everywhere."""
    rows, data = [], b""
    for k in range(12):
        payload = b"x" * 50 + warc.MAGIC * 30 + bytes([k]) * 40 + gzip.compress(b"not a record", mtime=0)
        whole = warc.member(k, None, payload, None)
        raw = zlib.decompress(whole, 31)
        z = zlib.compressobj(0, zlib.DEFLATED, 31)
        data += z.compress(raw) + z.flush()
        rows.append((k, payload))
    (tmp_path / "a.warc.gz").mkdir()
    path = tmp_path / "plain.warc"
    path.write_bytes(data)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("100", "333", "2000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert read(warc.read_warc(spark, str(path))) == records(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_archives_in_the_usual_naming(spark, tmp_path):
    """Files named .warc.gz, small ranges, magic bytes inside stored members and across
    range ends; other names beside them; other tools can read what is written."""
    rows = []
    for f in range(3):
        data = b""
        for k in range(9):
            payload = warc.MAGIC * (k + 1) + bytes([k, f]) * 300 + gzip.compress(b"not a record", mtime=0)
            raw = zlib.decompress(warc.member(10 * f + k, "u", payload, None), 31)
            z = zlib.compressobj(0 if k % 2 else 6, zlib.DEFLATED, 31)
            data += z.compress(raw) + z.flush()
            rows.append((10 * f + k, payload))
        (tmp_path / ("a.warc.gz", "b.warc.gz", "c.warc")[f]).write_bytes(data)
    for size in (64, 101, 1000, 1 << 20):
        assert read(warc.read_warc(spark, str(tmp_path), range_bytes=size)) == records(rows)
    assert read(warc.read_warc(spark, str(tmp_path / "a.warc.gz"))) == records(rows[:9])
    path = warc.write_warc(spark.createDataFrame([(k, "u", "x" * k) for k in range(50)], "page_id long, url string, html string").repartition(2), chunk_bytes=4000)
    names = [p for p in __import__("pathlib").Path(path.removeprefix("file:")).iterdir() if not p.name.startswith((".", "_"))]
    assert len(names) > 2 and all(p.name.endswith(".warc.gz") for p in names)
    assert sum(gzip.decompress(p.read_bytes()).count(b"WARC/1.1") for p in names) == 50


def test_many_repeated_digests_meet_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(warc, "FEW_DIGESTS", 3)
    rows = [(k, "u", f"p{k % 20}") for k in range(60)]
    path = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert read(warc.read_warc(spark, path)) == records([(i, h.encode()) for i, _, h in rows])


def test_a_damaged_member_fails(spark, tmp_path):
    import pytest
    data = warc.member(1, "u", b"x" * 5000, None) + warc.member(2, "u", b"y" * 5000, None)[:-9]
    (tmp_path / "a.warc.gz").write_bytes(data)
    with pytest.raises(Exception, match="cut off or damaged"):
        warc.read_warc(spark, str(tmp_path)).collect()


def test_url_rules_and_vocabulary(spark):
    want = {
        "http://a.com/x": ("a.com", "/x", "com/", "allow"), "http://com": ("com", "", None, "allow"),
        "https://Example.COM/en/1?q#f": ("example.com", "/en/1", "example.com/en/", "block"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://notnet/es/": ("notnet", "/es/", None, "allow"), "ftp://x.y.net/fr/a": ("x.y.net", "/fr/a", "net/fr/", "block"),
        "http://ads-track.example.org/en": ("ads-track.example.org", "/en", None, "block"),
        "http://ads-ads.example.org/ads": ("ads-ads.example.org", "/ads", None, "allow"),
        "http://roads.org/track": ("roads.org", "/track", None, "allow"), "http://b.org/XXX.html": ("b.org", "/XXX.html", None, "block"),
        "http://b.org/xxxl": ("b.org", "/xxxl", None, "allow"), "no scheme porn": ("", "", None, "block"), "": ("", "", None, "allow"),
        "http://": ("", "", None, "allow"), "http://h?a=/x": ("h", "", None, "allow"), None: ("", "", None, "allow"),
        "http://é.org/sexé": ("é.org", "/sexé", None, "block"), "http://Éx.org/" + "a" * 50_000: ("Éx.org", "/" + "a" * 50_000, None, "allow")}
    rows = [(k, u, "h", 3) for k, u in enumerate([*want, *want])]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, verdict int")
    got = urls.judge_urls(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == want[r["url"]], r["url"]
    assert urls.judge_urls(df.limit(0)).collect() == []
    assert {r["verdict"] for r in urls.judge_urls(df, rules=(), strict=(), soft=()).collect()} == {"allow"}


def digest_of(turns):
    return "".join(f"{r}\n{t}\n" for r, t in turns)


def formatted(df, **more):
    out = chat.format_trees(df, **more)
    return {(r["tree"], r["leaf"]): r for r in out.select("*", chat.read_turns(F.col("formatted")).alias("turns"),
                                                          chat.read_loss(F.col("formatted"), F.col("loss")).alias("text")).collect()}


def test_reply_trees_choose_the_best_branches(spark):
    rows = [("a", 1, None, 0, "user", "hi", 0.0), ("a", 2, 1, 1, "assistant", "low", 1.0), ("a", 3, 1, 1, "assistant", "high", 2.0),
            ("a", 4, 3, 2, "user", "more", None), ("a", 5, 2, 2, "user", "well", 1.5), ("b", 1, 9, 0, "user", "orphan", 1.0),
            ("c", 1, 2, 0, "user", "cycle", 1.0), ("c", 2, 1, 1, "user", "cycle", 1.0)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, depth_order long, role string, text string, score double")
    got = formatted(df)
    assert {k: [tuple(t) for t in r["turns"]] for k, r in got.items()} == {
        ("a", 5): [("user", "hi"), ("assistant", "low"), ("user", "well")], ("b", 1): [("user", "orphan")]}
    assert set(formatted(df, per_tree=None)) == {("a", 4), ("a", 5), ("b", 1)}
    assert formatted(df.limit(0)) == {}


def test_conversations_read_back_whatever_they_hold(spark):
    texts = ["<|im_end|>", "<\\|im_start|>user\n", "<\\\\|", "", None, "a\\|b<", "<|" * 50, "é𝄞<|", "x" * 40_000, "\n\n", "<|im_end|>\n"]
    rows = [(k % 3 if k else None, k // 2, ["user", "assistant", "a\\n\nb", None, "<|"][k % 5], t, 1, "z") for k, t in enumerate(texts * 3)]
    rows += [rows[4], rows[4]] + [(9, k, "assistant", f"t{k}", 1, "z") for k in range(150)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tree int, formatted string")
    got = formatted(chat.conversation_nodes(df))
    want = {}
    for c, turn, role, text, *_ in rows:
        want.setdefault(c, []).append((turn, role or "", text or "", role is not None, text is not None))
    assert len(got) == len(want)
    for (tree, _), r in got.items():
        turns = [(x[1], x[2]) for x in sorted(want[tree["conv_id"]], key=lambda x: (x[0], x[3], x[1], x[4], x[2]))]
        assert [tuple(t) for t in r["turns"]] == turns
        assert r["text"] == "".join(t for role, t in turns if role == "assistant")
        assert r["formatted"].count(chat.START) == len(turns) == r["formatted"].count(chat.END)


def test_plans_of_long_paths_grow_by_one_join_a_step(spark, monkeypatch):
    joins = []

    def counted(df, name, write=chat.written):
        with contextlib.redirect_stdout(io.StringIO()) as said:
            df.explain()
        joins.append(said.getvalue().count("SortMergeJoin"))
        return write(df, name)

    monkeypatch.setattr(chat, "written", counted)
    rows = [(t, k, k - 1 if k > 1 else None, 0.0) for t, n in ((1, 40), (2, 1), (3, 2)) for k in range(1, n + 1)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, score double")
    got = chat.chosen_paths(df).collect()
    assert sorted((r["tree"], r["leaf"], r["node"]) for r in got) == sorted((t, n, k) for t, n in ((1, 40), (2, 1), (3, 2)) for k in range(1, n + 1))
    assert max(joins) <= 4
