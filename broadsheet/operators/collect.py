"""The three source kinds become one ``collected`` table with an arrival key.

Arrival order decides which duplicate wins (A1) and breaks ranking ties (T1):
enabled feeds in configuration order, then community stories, then trending
models, each in document order. Rows have no order in Spark, so ``seq`` packs
``(kind, source or query ordinal, item ordinal)`` into one BIGINT. It is
computed row by row: no window, no shuffle, and the same value on every
re-execution (unlike ``monotonically_increasing_id``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Source kinds in arrival order and the bit layout of ``seq``.
FEED_KIND, STORY_KIND, MODEL_KIND = 0, 1, 2
MAJOR_BITS = 28        # feed position in the configuration, or story query position
MINOR_BITS = 32        # item position inside its document / answer
# ---------------------------------------------------------------------------

COLLECTED_COLUMNS = ("seq", "title", "snippet", "url", "source", "published_at", "points")


def arrival_seq(kind: int, major, minor) -> Column:
    """``kind << 60 | major << 32 | minor``; ordinals are 1-based or 0-based
    small integers, far below their field widths."""
    m = (F.col(major) if isinstance(major, str) else major).cast("bigint")
    n = (F.col(minor) if isinstance(minor, str) else minor).cast("bigint")
    return F.shiftleft(F.lit(kind).cast("bigint"), MAJOR_BITS + MINOR_BITS) \
        .bitwiseOR(F.shiftleft(m, MINOR_BITS)).bitwiseOR(n)


def collect_all(feeds: DataFrame | None = None, stories: DataFrame | None = None,
                models: DataFrame | None = None, by: Sequence[str] = ("edition_date",)) -> DataFrame:
    """``unionByName`` of whatever sources ran, with ``seq``.

    * ``feeds``: output of ``map_feed_items`` (``source_ordinal``, ``item_ordinal``);
    * ``stories``: output of ``merge_story_hits`` (``arrival`` struct of
      ``query_ordinal``, ``hit_pos``);
    * ``models``: output of ``model_items`` (``item_ordinal``).
    """
    parts = []
    if feeds is not None:
        parts.append(feeds.select(*by, arrival_seq(FEED_KIND, "source_ordinal", "item_ordinal").alias("seq"),
                                  "title", "snippet", "url", "source", "published_at",
                                  F.lit(None).cast("bigint").alias("points")))
    if stories is not None:
        parts.append(stories.select(*by, arrival_seq(STORY_KIND, F.col("arrival.query_ordinal"),
                                                     F.col("arrival.hit_pos")).alias("seq"),
                                    "title", "snippet", "url", "source", "published_at", "points"))
    if models is not None:
        parts.append(models.select(*by, arrival_seq(MODEL_KIND, F.lit(0), "item_ordinal").alias("seq"),
                                   "title", "snippet", "url", "source", "published_at", "points"))
    if not parts:
        raise ValueError("collect_all needs at least one source")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
