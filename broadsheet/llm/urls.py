"""URL filter: allow and block rules, then a weighted vocabulary.

One Aho-Corasick automaton finds the vocabulary's terms in a URL. A hit counts if
no letter or digit touches it. One strict term, or several distinct soft terms,
reject the URL. Rules on host and path decide before the vocabulary does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
         ("net/es/", "block"), ("net/fr/", "block"))
STRICT = ("adult", "casino", "malware", "nsfw", "phishing", "porn", "sex", "torrent", "viagra", "warez", "xxx")
SOFT = ("ad", "ads", "affiliate", "bet", "buy", "cheap", "click", "coupon", "deal", "free", "loan", "popup", "promo",
        "sale", "tracker", "track", "win")
SOFT_LIMIT = 2


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    path = rest[: min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))]
    return host.translate(LOWER), path


LOWER = {c: c + 32 for c in range(65, 91)}


def make_rule(rules: tuple[tuple[str, str], ...]):
    """A function from host and path to the longest rule that fits, and its verdict."""
    table: dict[str, list[tuple[str, str, str]]] = {}
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        host, _, path = rule.partition("/")
        table.setdefault(host, []).append((f"/{path}", rule, verdict))

    def find(host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[str | None, str | None] = None, None
        while host:
            for start, rule, verdict in table.get(host, ()):
                if path.startswith(start) and len(rule) > len(best[0] or ""):
                    best = rule, verdict
            host = host.partition(".")[2]
        return best

    return find


def make_vocabulary(strict: tuple[str, ...], soft: tuple[str, ...], soft_limit: int):
    """A function from a URL to whether the vocabulary rejects it."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    weights = {t: 0 for t in soft} | {t: 1 for t in strict}
    for term, weight in weights.items():
        automaton.add_word(term, (term, weight))
    if weights:
        automaton.make_automaton()

    def rejects(url: str) -> bool:
        if not weights:
            return False
        text, seen = url.translate(LOWER), set()
        for end, (term, weight) in automaton.iter(text):
            start = end - len(term)
            if start >= 0 and plain(text[start]) or end + 1 < len(text) and plain(text[end + 1]):
                continue
            if weight:
                return True
            seen.add(term)
            if len(seen) >= soft_limit:
                return True
        return False

    return rejects


def plain(c: str) -> bool:
    """An ASCII letter (lower case by then) or digit."""
    return "a" <= c <= "z" or "0" <= c <= "9"


def judge_urls(pages: DataFrame, url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES,
               strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """Add ``host, path, rule, verdict`` to rows with a URL (columns of these names
    are replaced). A rule ``host/path`` fits its host and all subdomains if the
    path starts with the rule's; the longest wins, and ``verdict`` is the rule's.
    Without a rule (null) it is ``block`` if the vocabulary rejects the URL, else
    ``allow``. A null URL has an empty host and path and is allowed. All rows
    stay, repeated ones too; an empty table gives no rows. No shuffle.
    """

    @F.pandas_udf("struct<host: string, path: string, rule: string, verdict: string>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        find, rejects = make_rule(rules), make_vocabulary(strict, soft, soft_limit)
        for urls in batches:
            out = []
            for url in urls:
                url = url if isinstance(url, str) else ""
                host, path = split_url(url)
                rule, verdict = find(host, path)
                out.append((host, path, rule, verdict or ("block" if rejects(url) else "allow")))
            yield pd.DataFrame(out, columns=["host", "path", "rule", "verdict"], dtype=object)

    own = ["host", "path", "rule", "verdict"]
    found = pages.drop(*[c for c in own if c != url_col]).withColumn("__judged", judge(F.col(url_col).cast("string")))
    return found.select("*", "__judged.*").drop("__judged")


ORACLE = """
WITH u AS (SELECT page_id, url, coalesce(strpos(url, '://'), 0) AS mark FROM pages),
r AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN mark > 0 THEN substr(url, mark + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, url, regexp_extract(rest, '^[^/?#]*') AS raw_host, rest FROM r),
p AS (SELECT page_id, url, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path,
             translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM h),
f AS (SELECT *, CASE
        WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(low, '(^|[^a-z0-9])(STRICT)([^a-z0-9]|$)') THEN 'block'
    WHEN len(list_filter([SOFT], lambda t: regexp_matches(low, '(^|[^a-z0-9])' || t || '([^a-z0-9]|$)'))) >= LIMIT THEN 'block'
    ELSE 'allow' END AS verdict
FROM f
""".replace("STRICT", "|".join(STRICT)).replace("SOFT", ", ".join(f"'{t}'" for t in SOFT)).replace("LIMIT", str(SOFT_LIMIT))
