"""J-POSTS as tables: post requests out, post answers in.

One post answer per digest item (keyed by rank) and per curated repo (keyed
by name). Calls are best effort: an answer that is missing, not JSON or JSON
``null`` leaves ``social`` null and the edition goes on. An answer that is
JSON but not an object still gives posts, built from the fallbacks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.prompts import repo_social_prompt, social_prompt
from broadsheet.functions.social import (assemble_linkedin, assemble_x, clean_hashtags_variant, string_or,
                                         strip_fences)
from broadsheet.functions.text import js_trim

# ---------------------------------------------------------------------------
# Call kinds of the post requests.
ITEM_CALL = "item_social"
REPO_CALL = "repo_social"
# ---------------------------------------------------------------------------


def social_struct(raw: Column, fallback_x: Column, fallback_linkedin: Column, url: Column) -> Column:
    """F14 + F10 + F15 on one raw answer: ``struct(x, linkedin)`` or null.

    Only a non-string hook falls back (an empty string does not); both hooks
    are trimmed the JS way afterwards.
    """
    v = F.try_parse_json(strip_fences(raw))
    tags = clean_hashtags_variant(v)
    hook_x = js_trim(string_or(v, "$.hook_x", fallback_x))
    hook_li = js_trim(string_or(v, "$.hook_linkedin", fallback_linkedin))
    ok = v.isNotNull() & ~F.is_variant_null(v)
    return F.when(ok, F.struct(assemble_x(hook_x, tags, url).alias("x"),
                               assemble_linkedin(hook_li, tags, url).alias("linkedin")))


def _answers(responses: DataFrame, kind: str, by: Sequence[str]) -> DataFrame:
    """The latest answer per key; duplicates are merged map-side first."""
    return (responses.where(F.col("call_kind") == kind)
            .groupBy(*by, "key").agg(F.max_by("raw", "attempt").alias("raw")))


def attach_item_social(items: DataFrame, responses: DataFrame, by: Sequence[str] = ("edition_date",)) -> DataFrame:
    """J6 for digest items (one row per item with ``rank, summary,
    why_it_matters, url``): X falls back to ``why_it_matters``, LinkedIn to
    ``summary``."""
    a = _answers(responses, ITEM_CALL, by)
    j = items.withColumn("key", F.col("rank").cast("string")).join(a, [*by, "key"], "left")
    return j.withColumn("social", social_struct(F.col("raw"), F.col("why_it_matters"), F.col("summary"),
                                                F.col("url"))).drop("key", "raw")


def attach_repo_social(repos: DataFrame, responses: DataFrame, by: Sequence[str] = ("edition_date",)) -> DataFrame:
    """J6 for curated repos (``name, description, url``): both posts fall back
    to the description."""
    a = _answers(responses, REPO_CALL, by)
    j = repos.withColumn("key", F.col("name")).join(a, [*by, "key"], "left")
    return j.withColumn("social", social_struct(F.col("raw"), F.col("description"), F.col("description"),
                                                F.col("url"))).drop("key", "raw")


def post_coverage(posted: DataFrame, by: Sequence[str] = ("edition_date",)) -> DataFrame:
    """A10: rows with posts out of all rows, per edition (partial aggregates)."""
    return posted.groupBy(*by).agg(F.count_if(F.col("social").isNotNull()).alias("n_posted"),
                                   F.count("*").alias("n_total"))


def post_requests(items: DataFrame | None = None, repos: DataFrame | None = None,
                  by: Sequence[str] = ("edition_date",)) -> DataFrame:
    """F23 + F24: one request row per item and per repo, in the
    ``(edition_date, call_kind, key, attempt, prompt)`` exchange shape."""
    parts = []
    if items is not None:
        parts.append(items.select(*by, F.lit(ITEM_CALL).alias("call_kind"),
                                  F.col("rank").cast("string").alias("key"), F.lit(1).alias("attempt"),
                                  social_prompt("title", "summary", "why_it_matters", "source").alias("prompt")))
    if repos is not None:
        parts.append(repos.select(*by, F.lit(REPO_CALL).alias("call_kind"), F.col("name").alias("key"),
                                  F.lit(1).alias("attempt"),
                                  repo_social_prompt("name", "description", "language", "stars", "url")
                                  .alias("prompt")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
