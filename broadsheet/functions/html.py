"""Readable text from HTML (F2-F7), as native column expressions.

Entity decoding replaces each match by a value computed from the match. Spark
has no callback replace, so a pass is written as: split the text around the
matches (``split`` keeps empty pieces), extract the matches in the same order
(``regexp_extract_all``) and stitch ``piece_i + decode(match_i)``. Text made by
one match is never seen again by the same pass, as with a JS global replace.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.functions.text import JS_SPACE_CLASS, collapse_ws, js_trim, replace_matches  # noqa: F401

# ---------------------------------------------------------------------------
# Fixed values.
# Named entities decoded by the article reader (lower-case name -> text).
NAMED_ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ",
    "mdash": "—", "ndash": "–", "hellip": "…",
    "rsquo": "’", "lsquo": "‘", "ldquo": "“", "rdquo": "”",
}
# Meta description patterns, tried in this order (og first, attributes both ways).
META_PATTERNS = [
    r"""(?i)<meta[^>]+property=["']og:description["'][^>]+content=["']([^"']+)["']""",
    r"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]+property=["']og:description["']""",
    r"""(?i)<meta[^>]+name=["']description["'][^>]+content=["']([^"']+)["']""",
    r"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]+name=["']description["']""",
]
PARAGRAPH_PATTERN = r"(?is)<p[^>]*>(.*?)</p>"    # DOTALL "." = any character, like [\s\S]
MIN_PARAGRAPH_CHARS = 60
MAX_PARAGRAPHS = 8
MAX_READABLE_CHARS = 1200
MIN_USABLE_CHARS = 80
# ---------------------------------------------------------------------------

_HEX_ENTITY = r"(?i)&#x([0-9a-f]+);"
_DEC_ENTITY = r"&#([0-9]+);"
_NAMED_ENTITY = r"(?i)&([a-z]+);"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def map_passes(arr: Column, *passes: Callable[[Column], Column]) -> Column:
    """Apply string passes to every element, one ``transform`` per pass: each
    pass sees its input as a lambda variable, so passes never inline each
    other's expressions."""
    for p in passes:
        arr = F.transform(arr, p)
    return arr


def code_point_char(cp: Column) -> Column:
    """The character of a code point; null when it is not a valid scalar value."""
    ok = cp.isNotNull() & (cp >= 0) & (cp <= 0x10FFFF) & ~cp.between(0xD800, 0xDFFF)
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32"))


def _hex_value(m: Column) -> Column:
    digits = F.regexp_extract(m, _HEX_ENTITY, 1)
    return F.when(F.length(F.ltrim(digits, F.lit("0"))) <= 6,
                  F.conv(F.coalesce(F.nullif(F.ltrim(digits, F.lit("0")), F.lit("")), F.lit("0")), 16, 10)
                  .cast("bigint"))


def _dec_value(m: Column) -> Column:
    digits = F.regexp_extract(m, _DEC_ENTITY, 1)
    return F.when(F.length(F.ltrim(digits, F.lit("0"))) <= 7,
                  F.coalesce(F.nullif(F.ltrim(digits, F.lit("0")), F.lit("")), F.lit("0")).cast("bigint"))


def _named(m: Column) -> Column:
    name = F.lower(F.regexp_extract(m, _NAMED_ENTITY, 1))
    table = F.create_map(*[x for k, v in NAMED_ENTITIES.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(table, name)


def _hex_pass(x: Column) -> Column:
    return F.when(x.contains("&#"), replace_matches(x, _HEX_ENTITY, lambda m: code_point_char(_hex_value(m)))) \
        .otherwise(x)


def _dec_pass(x: Column) -> Column:
    return F.when(x.contains("&#"), replace_matches(x, _DEC_ENTITY, lambda m: code_point_char(_dec_value(m)))) \
        .otherwise(x)


def _named_pass(x: Column) -> Column:
    return F.when(x.contains("&"), replace_matches(x, _NAMED_ENTITY, _named)).otherwise(x)


DECODE_PASSES = (_hex_pass, _dec_pass, _named_pass)


def decode_entities_all(arr: Column) -> Column:
    """F2 on every element of an array of strings."""
    return map_passes(arr, *DECODE_PASSES)


def decode_entities(col) -> Column:
    """F2 (article reader): hex, then decimal, then the 13 names; one pass each.
    Invalid code points leave the entity text as it is."""
    return F.element_at(decode_entities_all(F.array(_c(col))), 1)


def strip_tags_all(arr: Column) -> Column:
    """F3 on every element: tag -> space, entities, collapse white space, trim."""
    return map_passes(arr, lambda x: F.regexp_replace(x, "<[^>]+>", " "), *DECODE_PASSES,
                      lambda x: js_trim(collapse_ws(x)))


def strip_tags(col) -> Column:
    """every tag becomes a space, entities decoded, white space collapsed, trimmed."""
    return F.element_at(strip_tags_all(F.array(_c(col))), 1)


def meta_description(col) -> Column:
    """the first non-empty capture of the four meta patterns, decoded and trimmed.

    Every pattern needs the word ``description`` (ASCII case-insensitive), so
    pages without it skip the four regex scans; the guard cannot reject a page
    a pattern would match.
    """
    html = _c(col)
    caps = [F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in META_PATTERNS]
    found = F.coalesce(js_trim(decode_entities(F.coalesce(*caps))), F.lit(""))
    return F.when(html.ilike("%description%"), found).otherwise(F.lit(""))


def _strip_one(x: Column) -> Column:
    return F.element_at(strip_tags_all(F.array(x)), 1)


def readable_paragraphs(col) -> Column:
    """T5: the first 8 paragraphs whose stripped text has at least 60 characters.

    A fold over the paragraphs in page order: once 8 are kept the remaining
    ones are not stripped at all (``when`` skips the work), as the original
    loop stops early. Stripping never makes a paragraph longer, so raw ones
    shorter than 60 characters are dropped before the fold.
    """
    raw = F.filter(F.regexp_extract_all(_c(col), F.lit(PARAGRAPH_PATTERN), 1),
                   lambda r: F.length(r) >= MIN_PARAGRAPH_CHARS)

    def step(kept: Column, r: Column) -> Column:
        t = _strip_one(r)
        return F.when(F.size(kept) >= MAX_PARAGRAPHS, kept) \
            .when(F.length(t) >= MIN_PARAGRAPH_CHARS, F.array_append(kept, t)).otherwise(kept)

    return F.aggregate(raw, F.array().cast("array<string>"), step)


def extract_readable(col, max_chars: int = MAX_READABLE_CHARS) -> Column:
    """meta description + first paragraphs, joined by a space, cut, trimmed."""
    html = _c(col)
    desc = meta_description(html)
    parts = F.concat(F.when(desc != "", F.array(desc)).otherwise(F.array().cast("array<string>")),
                     readable_paragraphs(html))
    return js_trim(F.substring(F.array_join(parts, " "), 1, max_chars))


def usable_text(col, min_chars: int = MIN_USABLE_CHARS) -> Column:
    """the text when it has at least ``min_chars`` characters, else null."""
    t = _c(col)
    return F.when(F.length(t) >= min_chars, t)


def strip_html_repo(col) -> Column:
    """F7 (trending page variant): tags removed (no space), then ``&amp;`` first,
    so double-encoded text decodes twice; decimal entities only; collapse; trim."""
    s = F.regexp_replace(_c(col), "<[^>]+>", "")
    for ent, ch in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        s = F.replace(s, F.lit(ent), F.lit(ch))
    return F.element_at(map_passes(F.array(s), _dec_pass,
                                   lambda x: js_trim(F.regexp_replace(x, f"{JS_SPACE_CLASS}+", " "))), 1)
