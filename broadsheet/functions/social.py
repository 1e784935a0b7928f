"""Social post columns (F8-F11, F14, F15, T6). Native expressions only.

Lengths are code points, as Spark's ``length`` / ``substring`` count them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.functions.html import map_passes, replace_matches
from broadsheet.functions.text import _ASCII_SPACES, _WIDE_SPACES, js_trim

# ---------------------------------------------------------------------------
# Fixed values.
X_LIMIT = 280          # post limit on X, in code points
URL_WEIGHT = 23        # any link counts as 23
ELLIPSIS = "…"
MAX_HASHTAGS = 4
# First code points of the mathematical sans-serif bold capitals, small letters
# and digits; each block is consecutive in A-Z / a-z / 0-9 order.
BOLD_CAPITAL_A = 0x1D5D4
BOLD_SMALL_A = 0x1D5EE
BOLD_DIGIT_ZERO = 0x1D7EC
# Bold markers: **text**, lazy, within one line (JS "." excludes these four).
BOLD_PATTERN = r"\*\*([^\n\r\u2028\u2029]+?)\*\*"
# One surrounding code fence, with an optional json tag.
FENCE_PATTERN = r"^```(?:json)?\s*([\s\S]*?)\s*```$"
# ---------------------------------------------------------------------------

_PLAIN = ("".join(chr(c) for c in range(ord("A"), ord("Z") + 1))
          + "".join(chr(c) for c in range(ord("a"), ord("z") + 1))
          + "".join(chr(c) for c in range(ord("0"), ord("9") + 1)))
_BOLD = ("".join(chr(BOLD_CAPITAL_A + i) for i in range(26))
         + "".join(chr(BOLD_SMALL_A + i) for i in range(26))
         + "".join(chr(BOLD_DIGIT_ZERO + i) for i in range(10)))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bold_sans(col) -> Column:
    """F8: ASCII letters and digits to sans-serif bold, everything else kept."""
    return F.translate(_c(col), _PLAIN, _BOLD)


def _bold_pass(x: Column) -> Column:
    return F.when(x.contains("**"), replace_matches(
        x, BOLD_PATTERN, lambda m: bold_sans(F.regexp_extract(m, BOLD_PATTERN, 1)))).otherwise(x)


def apply_bold(col) -> Column:
    """every ``**text**`` becomes the bold form of text, asterisks removed."""
    return F.element_at(map_passes(F.array(_c(col)), _bold_pass), 1)


def join_tags(tags) -> Column:
    return F.coalesce(F.array_join(_c(tags), " "), F.lit(""))


def assemble_x(hook, tags, url) -> Column:
    """hook (+ blank line + tags when it fits), else hook alone, else the
    first 255 code points right-trimmed plus an ellipsis; then newline + URL.
    The URL weighs 23 and the newline 1."""
    hook, url = _c(hook), _c(url)
    t = join_tags(tags)
    overhead = 1 + URL_WEIGHT
    with_tags = F.when(t != "", F.concat(hook, F.lit("\n\n"), t)).otherwise(hook)
    allowed = max(0, X_LIMIT - overhead - 1)
    cut = F.concat(F.rtrim(F.substring(hook, 1, allowed), F.lit(_ASCII_SPACES + _WIDE_SPACES)), F.lit(ELLIPSIS))
    body = (F.when(F.length(with_tags) + overhead <= X_LIMIT, with_tags)
            .when(F.length(hook) + overhead <= X_LIMIT, hook)
            .otherwise(cut))
    return F.concat(body, F.lit("\n"), url)


def assemble_linkedin(hook, tags, url) -> Column:
    """bold hook, tags when there are any, URL; blank-line separated."""
    t = join_tags(tags)
    return F.concat_ws("\n\n", apply_bold(_c(hook)), F.nullif(t, F.lit("")), _c(url))


def clean_hashtags(tags) -> Column:
    """F14 + T6 for an ``array<string>``: nulls dropped, ``#`` prefixed when
    missing, bare ``#`` dropped, first four kept."""
    arr = F.filter(_c(tags), lambda x: x.isNotNull())
    arr = F.transform(arr, lambda x: F.when(F.startswith(x, F.lit("#")), x).otherwise(F.concat(F.lit("#"), x)))
    return F.slice(F.filter(arr, lambda x: F.length(x) > 1), 1, MAX_HASHTAGS)


def clean_hashtags_variant(v) -> Column:
    """F14 on a model answer (VARIANT): not an array -> none; only JSON strings
    count (a number is not turned into text)."""
    items = F.coalesce(F.try_variant_get(_c(v), "$.hashtags", "array<variant>"), F.array().cast("array<variant>"))
    strings = F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"),
                          lambda x: F.variant_get(x, "$", "string"))
    return clean_hashtags(strings)


def strip_fences(col) -> Column:
    """trim, then remove one surrounding code fence when there is one."""
    t = js_trim(_c(col))
    return F.when(t.rlike(FENCE_PATTERN), F.regexp_extract(t, FENCE_PATTERN, 1)).otherwise(t)


def string_or(v, path: str, fallback) -> Column:
    """The string at ``path`` of a VARIANT, or ``fallback`` when it is not a
    JSON string (an empty string does not trigger the fallback)."""
    node = F.try_variant_get(_c(v), path, "variant")
    return F.when(F.schema_of_variant(node) == "STRING", F.variant_get(node, "$", "string")) \
        .otherwise(_c(fallback))
