"""The first rows of each group in two steps, for hot groups and for a k that is data.

``row_number() <= k`` alone keeps k rows of a group in every map task and sends
them all to one reducer, which at very many map tasks is a lot for a hot group. So
groups are first cut in parts by a row hash, each part keeps its k best, and only
these meet. Both steps plan as WindowGroupLimit.

WindowGroupLimit needs a literal. Where k is a column (one value for each group),
the literal is the largest k there is, and the column cuts what is left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 64


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int | Column, name: str,
                  spread: Sequence[str], most: int | None = None, parts: int = PARTS) -> DataFrame:
    """Add ``name``, the position (from 1) in the order of ``order`` within ``by``, and
    keep the first ``k`` of each group; no task reads more than ``parts`` times the
    largest k for a group.

    ``k`` is a number, or a column together with ``most``, the largest value it
    takes; a null k keeps nothing. ``spread`` names the columns whose hash deals a
    group's rows to its parts; they should tell rows apart.
    """
    limit = k if isinstance(k, int) else most
    if limit is None:
        raise ValueError("a column k needs its largest value")
    part = F.pmod(F.xxhash64(*spread), F.lit(parts))
    near = Window.partitionBy(*by, part).orderBy(*order)
    best = df.withColumn("__near", F.row_number().over(near)).where(F.col("__near") <= limit).drop("__near")
    out = best.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= limit)
    return out if isinstance(k, int) else out.where(F.col(name) <= k)
