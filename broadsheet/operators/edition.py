"""Accepted answers -> edition documents (F13, J6 input, K1 input).

An accepted answer (W5) still holds its items as VARIANT after J2. Its items
are typed here (the rules already proved their types), posts are attached
with ``operators.social``, and one document row per edition is assembled:
run metadata always comes from the run (F13), items keep the answer's order,
repos come from the repo picks (J4 + W6). Every list gathered per edition is
bounded by a rule: at most 20 items (V3) and ``pick`` repos (W6).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.sources.editions import SOCIAL

ITEM_TEXT_FIELDS = ("category", "title", "summary", "why_it_matters", "url", "source")
REPO_FIELDS = ("name", "url", "description", "language", "stars")


def accepted_items(accepted: DataFrame, by: tuple[str, ...] = ("edition_date",)) -> DataFrame:
    """One typed row per item of each accepted answer, ``pos`` = answer order.

    ``answer_social`` is the answer's own ``social`` object when it has one;
    a post made later replaces it, a failed post leaves it in place.
    """
    e = accepted.select(*by, F.posexplode("items").alias("pos", "x"))
    x = F.col("x")
    return e.select(*by, (F.col("pos") + 1).alias("pos"),
                    F.variant_get(x, "$.rank", "int").alias("rank"),
                    *[F.variant_get(x, f"$.{k}", "string").alias(k) for k in ITEM_TEXT_FIELDS],
                    F.try_variant_get(x, "$.social", SOCIAL).alias("answer_social"))


def _item_struct() -> Column:
    social = F.col("social")
    if_answer = F.col("answer_social")
    return F.struct(F.col("rank"), *[F.col(k) for k in ITEM_TEXT_FIELDS],
                    F.coalesce(social, if_answer).alias("social"))


def assemble_editions(items: DataFrame, runs: DataFrame, repos: DataFrame | None = None,
                      by: str = "edition_date") -> DataFrame:
    """Edition documents: ``edition_date, date, generated_at, provider, items,
    repos``.

    * ``items``: ``accepted_items`` output with ``social`` attached (J6);
    * ``runs``: ``edition_date, date, generated_at, provider``;
    * ``repos``: picked repos with ``seq`` (pick order) and ``social``, or
      ``None``; an edition without picks has null ``repos`` (omitted from JSON).
    """
    if "social" not in items.columns:
        items = items.withColumn("social", F.lit(None).cast(SOCIAL))
    if "answer_social" not in items.columns:
        items = items.withColumn("answer_social", F.lit(None).cast(SOCIAL))
    its = items.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col("pos"), _item_struct().alias("i"))))
                                .alias("_its"))
    out = runs.select(by, "date", "generated_at", "provider").join(its, by) \
        .withColumn("items", F.transform("_its", lambda p: p["i"])).drop("_its")
    if repos is None:
        return out.withColumn("repos", F.lit(None).cast(f"array<struct<name: string, url: string, "
                                                        f"description: string, language: string, stars: bigint, "
                                                        f"social: {SOCIAL}>>"))
    if "social" not in repos.columns:
        repos = repos.withColumn("social", F.lit(None).cast(SOCIAL))
    rs = repos.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(
        F.col("seq"), F.struct(*[F.col(c) for c in REPO_FIELDS], F.col("social")).alias("r")))).alias("_rs"))
    return out.join(rs, by, "left").withColumn("repos", F.transform("_rs", lambda p: p["r"])).drop("_rs")
