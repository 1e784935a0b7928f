"""Text and URL columns (F1, F29, F30 and helpers). Native expressions only.

All functions take and return ``Column`` objects so Catalyst keeps them inside
whole-stage codegen; no Python UDF is involved.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.functions.hosts import serialized_host

# ---------------------------------------------------------------------------
# Fixed values.
# The white-space class of JavaScript's String.prototype.trim and of the regex
# class \s (ECMAScript WhiteSpace + LineTerminator). Java's \s and Spark's
# trim() only cover ASCII, so the class is spelled out (Java regex escapes).
JS_SPACE_CLASS = r"[\t\n\u000B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
# Query keys dropped by canonical_url: prefix utm_ (any case), exactly ref, exactly fbclid.
TRACKING_KEY_PREFIX = "utm_"
TRACKING_KEYS = ("ref", "fbclid")
# Default ports removed by URL serialisation.
DEFAULT_PORTS = {"http": "80", "https": "443"}
# ---------------------------------------------------------------------------

_URL_PATTERN = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#\\]+)([^?#]*)(\?[^#]*)?(#.*)?$"
_BIG = 1 << 30


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def replace_matches(s: Column, pattern: str, decode: Callable[[Column], Column]) -> Column:
    """Global regex replace where the replacement is ``decode(match)``;
    ``decode`` returns null to leave a match as it is.

    ``zip_with`` pairs piece i with match i (the last piece gets null), so the
    text is split and scanned once. Call it on a lambda variable or a column:
    the input expression appears three times.
    """
    pieces = F.split(s, pattern, -1)
    matches = F.regexp_extract_all(s, F.lit(pattern), 0)
    stitched = F.zip_with(pieces, matches,
                          lambda piece, m: F.concat(piece, F.coalesce(decode(m), m, F.lit(""))))
    return F.when(s.isNull(), s).otherwise(F.array_join(stitched, ""))


# The same class as plain characters: the ASCII ones (exactly Java's \s set)
# and the non-ASCII ones, which are first mapped to a space with translate().
_ASCII_SPACES = "\t\n\u000b\f\r "
_WIDE_SPACES = "\u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def js_trim(col) -> Column:
    """Trim with the JavaScript white-space class (F30); a character-set trim,
    no regex."""
    return F.trim(_c(col), F.lit(_ASCII_SPACES + _WIDE_SPACES))


def collapse_ws(col) -> Column:
    """Replace every run of JS white space with one ASCII space (``/\\s+/g``)."""
    return F.regexp_replace(F.translate(_c(col), _WIDE_SPACES, " " * len(_WIDE_SPACES)), r"\s+", " ")


def _form_decode(s: Column) -> Column:
    """application/x-www-form-urlencoded decoding; a malformed escape stays as
    text, the valid ones beside it are decoded."""
    return F.try_url_decode(F.regexp_replace(s, "%(?![0-9A-Fa-f]{2})", "%25"))


def _pair_key(p: Column) -> Column:
    return _form_decode(F.substring_index(p, "=", 1))


def _pair_value(p: Column) -> Column:
    return F.when(F.locate("=", p) > 0, F.substring(p, F.locate("=", p) + 1, _BIG)).otherwise(F.lit(""))


def _is_tracking_key(decoded_key: Column) -> Column:
    prefix = F.lower(F.substring(decoded_key, 1, len(TRACKING_KEY_PREFIX))) == TRACKING_KEY_PREFIX
    return prefix | decoded_key.isin(*TRACKING_KEYS)


def _serialize_pair(p: Column) -> Column:
    """One ``name=value`` pair as URLSearchParams writes it (form encoding;
    Java's URLEncoder uses the same safe set ``A-Za-z0-9*-._`` and ``+`` for space)."""
    return F.concat(F.url_encode(_pair_key(p)), F.lit("="), F.url_encode(_form_decode(_pair_value(p))))


def drop_last_slash(s: Column) -> Column:
    return F.regexp_replace(s, "/\\z", "")


# Characters the URL standard percent-encodes (as UTF-8) when it serialises an
# http(s) URL: in the path C0 controls, space, " # < > ? ` { } and everything
# above "~"; in the query C0 controls, space, " # < > ' and everything above
# "~". Written as the complement (the printable ASCII characters kept as they
# are), which is the same set.
PATH_ENCODE_CLASS = r"[^\x21\x24-\x3B\x3D\x40-\x5F\x61-\x7A\x7C\x7E]"
QUERY_ENCODE_CLASS = r"[^\x21\x24-\x26\x28-\x3B\x3D\x3F-\x7E]"

# Dot segments as the URL standard spells them (compared lower-cased).
SINGLE_DOT = (".", "%2e")
DOUBLE_DOT = ("..", ".%2e", "%2e.", "%2e%2e")
_DOT_SEGMENT = r"/(\.|%2[eE])"


def percent_encode(s: Column, char_class: str) -> Column:
    """Percent-encode (UTF-8, upper-case hex) every character of ``char_class``;
    everything else, including existing ``%XX`` escapes, stays as it is. Runs
    of such characters go through ``url_encode``, whose only other change,
    space to ``+``, is turned into ``%20`` (a run holds no literal ``+``)."""
    return F.when(s.rlike(char_class), replace_matches(
        s, char_class + "+", lambda m: F.replace(F.url_encode(m), F.lit("+"), F.lit("%20")))).otherwise(s)


def resolve_path(path: Column) -> Column:
    """Path of an http(s) URL as the URL standard serialises it: ``\\`` is a
    separator, single-dot segments vanish, a double-dot segment removes the
    segment before it, and a dot segment at the end leaves a trailing ``/``.
    ``path`` starts with ``/``. Paths without a dot segment are returned as
    they are (after the backslash rule)."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    segs = F.split(F.substring(p, 2, _BIG), "/", -1)
    n = F.size(segs)

    def step(acc: Column, x: Column) -> Column:
        low, last = F.lower(x["s"]), x["i"] == n - 1
        popped = F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)
        return (F.when(low.isin(*DOUBLE_DOT), F.when(last, F.array_append(popped, F.lit(""))).otherwise(popped))
                .when(low.isin(*SINGLE_DOT), F.when(last, F.array_append(acc, F.lit(""))).otherwise(acc))
                .otherwise(F.array_append(acc, x["s"])))

    indexed = F.transform(segs, lambda seg, i: F.struct(seg.alias("s"), i.alias("i")))
    resolved = F.aggregate(indexed, F.array().cast("array<string>"), step)
    return F.when(p.rlike(_DOT_SEGMENT), F.concat(F.lit("/"), F.array_join(resolved, "/"))).otherwise(p)


def _url_parts(t: Column) -> Column:
    # the URL parser drops ASCII tabs and newlines anywhere in its input; an
    # input it rejects is returned trimmed but otherwise untouched (``t``)
    c = F.regexp_replace(t, r"[\t\n\r]", "")
    return F.struct(
        t.alias("t"), c.rlike(_URL_PATTERN).alias("ok"),
        F.lower(F.regexp_extract(c, _URL_PATTERN, 1)).alias("scheme"),
        F.regexp_extract(c, _URL_PATTERN, 2).alias("authority"),
        F.regexp_extract(F.regexp_extract(c, _URL_PATTERN, 2), "([^@]*)$", 1).alias("hostport"),
        F.regexp_extract(c, _URL_PATTERN, 3).alias("path"),
        F.regexp_extract(c, _URL_PATTERN, 4).alias("query"))


def _with_host(u: Column) -> Column:
    """The host as it is written; a host that the standard rejects is empty, which
    leaves the URL as it is."""
    return u.withField("host", F.coalesce(serialized_host(F.regexp_extract(u["hostport"], r"^(.*?)(:[0-9]*)?$", 1)), F.lit("")))


def _canonical_from_parts(u: Column) -> Column:
    scheme, path, query = u["scheme"], u["path"], u["query"]
    # user info keeps its case; an empty password or empty user info goes
    user = F.regexp_replace(F.regexp_extract(u["authority"], "^(.*@)", 1), ":?@$", "@")
    user = F.when(user == "@", F.lit("")).otherwise(user)
    host = u["host"]
    # the port is a number: leading zeros go, above 65535 the URL is rejected
    port_digits = F.regexp_extract(u["hostport"], r":([0-9]*)$", 1)
    port_num = F.when(F.length(F.ltrim(port_digits, F.lit("0"))) <= 5, port_digits.try_cast("int"))
    port = F.when(port_digits == "", F.lit("")).otherwise(port_num.cast("string"))
    port_ok = (port_digits == "") | (port_num <= 65535)
    default_port = ((scheme == "http") & (port == DEFAULT_PORTS["http"])) | \
        ((scheme == "https") & (port == DEFAULT_PORTS["https"]))
    authority = F.when((port != "") & ~default_port, F.concat(host, F.lit(":"), port)).otherwise(host)
    path = percent_encode(resolve_path(F.when(path == "", F.lit("/")).otherwise(path)), PATH_ENCODE_CLASS)

    pairs = F.filter(F.split(F.substring(query, 2, _BIG), "&"), lambda p: p != "")
    drops = F.exists(pairs, lambda p: _is_tracking_key(_pair_key(p)))
    kept = F.array_join(
        F.transform(F.filter(pairs, lambda p: ~_is_tracking_key(_pair_key(p))), _serialize_pair), "&")
    new_query = F.when(drops, F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept))) \
        .otherwise(percent_encode(query, QUERY_ENCODE_CLASS))
    is_web = u["ok"] & scheme.isin("http", "https") & (host != "") & F.coalesce(port_ok, F.lit(False))
    rebuilt = drop_last_slash(F.concat(scheme, F.lit("://"), user, authority, path, new_query))
    return F.when(is_web, rebuilt).otherwise(u["t"])


def canonical_url(col) -> Column:
    """dedup key of a URL.

    Trim; http(s) URLs get lower-case scheme and host, default port removed,
    empty path shown as ``/``, fragment removed, ``utm_*`` / ``ref`` /
    ``fbclid`` query keys removed (the rest of the query is then re-serialised
    as form data; untouched when nothing is removed) and one trailing ``/`` of
    the whole string removed. Anything that is not an http(s) URL with a host
    is returned trimmed. Dot segments and backslashes in the path are resolved
    and raw characters of the path and of an untouched query are
    percent-encoded, as the URL standard serialises them. Hosts follow it too (see
    ``hosts.serialized_host``): Punycode, IPv4 numbers, shortest IPv6. A letter and a
    combining mark are not composed first.

    The URL is split once and the parts are bound as a lambda variable, so the
    rebuilding steps never repeat the split.
    """
    parts = F.transform(F.transform(F.array(js_trim(col)), _url_parts), _with_host)
    return F.element_at(F.transform(parts, _canonical_from_parts), 1)


def url_host(col) -> Column:
    """Lower-case host of an http(s) URL ('' when there is none)."""
    return F.lower(F.regexp_extract(_c(col), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]+)", 1))


def sha8(col) -> Column:
    """first 8 hex digits of SHA-256; ``'0'`` when there is nothing to read."""
    return F.coalesce(F.substring(F.sha2(_c(col), 256), 1, 8), F.lit("0"))
