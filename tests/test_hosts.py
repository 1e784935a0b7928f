"""Hosts of URLs against literals, Python's own Punycode codec and ipaddress (F1)."""

import ipaddress
import random

from pyspark.sql import functions as F

from broadsheet.functions.hosts import ipv4, ipv6, punycode, serialized_host
from broadsheet.functions.text import canonical_url
from conftest import one

HOSTS = {
    "Example.COM": "example.com", "Bücher.example": "xn--bcher-kva.example", "xn--bcher-kva.example": "xn--bcher-kva.example",
    "例え.テスト": "xn--r8jz45g.xn--zckzah", "ｇｏ.example": "go.example", "a。b": "a.b", "faß.de": "xn--fa-hia.de",
    "0x7f.1": "127.0.0.1", "127.1": "127.0.0.1", "2130706433": "127.0.0.1", "0177.0.0.01": "127.0.0.1", "1.2.3.4.": "1.2.3.4", "256.1.1.1": None,
    "1.2.3.4.5": None, "0x": "0.0.0.0", "1.2.3.08": None, "4294967296": None, "4294967295": "255.255.255.255", "a.0x1": None, "1.a": "1.a",
    "%41.example": "a.example", "a%2Fb": None, "%7f": None, "a<b": None, "%zz": None, "b%C3%BCcher.example": "xn--bcher-kva.example",
    "[::1]": "[::1]", "[0:0:0:0:0:0:0:1]": "[::1]", "[2001:DB8:0:0:1:0:0:1]": "[2001:db8::1:0:0:1]", "[::ffff:1.2.3.4]": "[::ffff:102:304]",
    "[1:2:3:4:5:6:7:8]": "[1:2:3:4:5:6:7:8]", "[1:2]": None, "[1::2::3]": None, "[::g]": None, "[1:0:2:3:4:5:6:7]": "[1:0:2:3:4:5:6:7]", "[::]": "[::]",
    "[1:2:3:4:5:6:7::]": "[1:2:3:4:5:6:7:0]", "[::1.2.3]": None, "[:1]": None, "[]": None, "a_b-.x": "a_b-.x", "x.1e": "x.1e",
}


def test_hosts(spark):
    got = one(spark, serialized_host(F.col("h")), schema="h string", rows=[(h,) for h in HOSTS])
    assert dict(zip(HOSTS, got)) == HOSTS


def test_punycode_equals_the_codec(spark):
    rng = random.Random(6)
    pool = "abcz09-" + "éüßāαאก例え가\U0001f600\U00010348"
    labels = ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 40))) for _ in range(150)] + ["他" * 60, "a" * 50 + "é"]
    labels = [x for x in labels if not x.isascii()]
    got = one(spark, punycode(F.col("h")), schema="h string", rows=[(x,) for x in labels])
    assert got == [x.encode("punycode").decode() for x in labels]


def test_ipv6_equals_ipaddress(spark):
    rng = random.Random(7)
    addresses = [ipaddress.IPv6Address(sum(rng.choice([0, 0, rng.randrange(1 << 16)]) << 16 * k for k in range(8))) for _ in range(200)]
    spelled = [a.exploded.upper() if k % 2 else a.compressed for k, a in enumerate(addresses)]
    want = []
    for a in addresses:  # ipaddress shortens a single zero group as well, and writes some as IPv4
        groups = [format(int(g, 16), "x") for g in a.exploded.split(":")]
        runs = [(n, -at) for at in range(8) for n in range(8, 1, -1) if groups[at: at + n] == ["0"] * n]
        n, at = max(runs, default=(0, 0))
        want.append(":".join(groups) if not n else ":".join(groups[:-at]) + "::" + ":".join(groups[-at + n:]))
    assert one(spark, ipv6(F.col("h")), schema="h string", rows=[(s,) for s in spelled]) == want


def test_ipv4_numbers(spark):
    rng = random.Random(8)
    rows, want = [], []
    for _ in range(200):
        v = rng.randrange(1 << 32)
        n = rng.randrange(1, 5)
        parts = [(v >> 24 - 8 * k) & 255 for k in range(n - 1)] + [v & (1 << 8 * (5 - n)) - 1]
        rows.append((".".join(rng.choice([str, hex, lambda x: "0%o" % x if x else "0"])(p) for p in parts),))
        want.append(str(ipaddress.IPv4Address(v)))
    assert one(spark, ipv4(F.col("h")), schema="h string", rows=rows) == want


def test_two_spellings_are_one_candidate(spark):
    urls = {"http://BÜCHER.example/a/": "http://xn--bcher-kva.example/a", "http://xn--bcher-kva.example/a": "http://xn--bcher-kva.example/a",
            "http://u:p@0x7f.1:80/?utm_x=1": "http://u:p@127.0.0.1", "http://[0:0::1]:8080/a": "http://[::1]:8080/a",
            "http://a<b/": "http://a<b/", "http://1.2.3.999/x/": "http://1.2.3.999/x/"}
    assert one(spark, canonical_url("u"), schema="u string", rows=[(u,) for u in urls]) == [*urls.values()]
