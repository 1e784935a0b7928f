"""J-ENRICH: article text for the top candidates of each edition.

A page belongs to the edition it was fetched for. Its text is extracted in the
task that scans it, so no shuffle ever carries ``html``: only the key and the cut
text meet the targets (at most 30 per edition). That join is an inner one on
distinct keys, because Catalyst would push a semi-join below the extraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.html import extract_readable, usable_text
from broadsheet.functions.text import canonical_url
from broadsheet.operators.dedup import ENRICH_TOP

KEY = ["edition_date", "url"]


def fetchable(pages: DataFrame) -> DataFrame:
    """Only 2xx answers whose content type mentions html are read."""
    return pages.where(F.col("status").between(200, 299) & F.col("content_type").contains("html"))


def page_texts(pages: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Usable readable text (F5 + F6) per edition and canonical URL; the first
    landed page (smallest ``page_id``) stands for its key. ``keys`` are distinct."""
    t = fetchable(pages).select("edition_date", canonical_url(F.col("url")).alias("url"), "page_id",
                                usable_text(extract_readable(F.col("html"))).alias("content"))
    if keys is not None:
        t = t.join(keys, KEY)
    return t.groupBy(*KEY).agg(F.min_by("content", "page_id").alias("content"))


def enrich(ranked: DataFrame, pages: DataFrame, top: int | Column = ENRICH_TOP) -> DataFrame:
    """T2 + J1: ``content`` for the first ``top`` candidates of each edition (a number
    or a column of ``ranked``), null for the rest and for pages without usable text."""
    targets = ranked.where(F.col("position") <= top).select(*KEY).distinct()
    texts = page_texts(pages, targets)
    return (ranked.join(texts, KEY, "left")
            .withColumn("content", F.when(F.col("position") <= top, F.col("content"))))


def enrich_rate(enriched: DataFrame, top: int | Column = ENRICH_TOP) -> DataFrame:
    """Targets and successful reads per edition."""
    t = enriched.where(F.col("position") <= top)
    return t.groupBy("edition_date").agg(F.count("*").alias("n_targets"),
                                         F.count_if(F.col("content").isNotNull()).alias("n_ok"))
