"""Source configuration (S5): a JSON document, read with an explicit schema.

A configuration is a DataFrame of one row, or of one row for each edition with a
column ``edition_date`` (editions of different days may have been configured
differently). Its lists become rows (``enabled_sources`` for the feeds,
``story_queries``) that are joined to the landed documents; its scalars become
columns beside each edition (``edition_settings``), so limits are data, too.
``job_parameters`` reads the scalars of a single row for other uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.operators.dedup import CANDIDATE_CAP, ENRICH_TOP
from broadsheet.operators.ingest import STORY_MIN_POINTS, WINDOW_HOURS
from broadsheet.operators.repos import PICK
from broadsheet.sources.feeds import enabled_sources
from broadsheet.sources.trending import TRENDING_LIMIT

# ---------------------------------------------------------------------------
# The configuration document's schema.
CONFIG_SCHEMA = (
    "user_agent string, timeout_ms int, window_hours int, candidate_cap int, enrich_top int, "
    "enrich_timeout_ms int, "
    "rss array<struct<id: string, name: string, url: string, enabled: boolean, fragile: boolean>>, "
    "hackernews struct<id: string, name: string, enabled: boolean, min_points: int, queries: array<string>>, "
    "huggingface_trending struct<id: string, name: string, enabled: boolean, `limit`: int>, "
    "github_trending struct<id: string, name: string, enabled: boolean, since: string, `limit`: int, pick: int>")
# ---------------------------------------------------------------------------

# Settings of an edition that its configuration does not mention.
DEFAULTS = {"window_hours": WINDOW_HOURS, "candidate_cap": CANDIDATE_CAP, "enrich_top": ENRICH_TOP, "min_points": STORY_MIN_POINTS,
            "models_limit": 20, "repos_limit": TRENDING_LIMIT, "pick": PICK,
            "stories_enabled": False, "models_enabled": False, "repos_enabled": False}

__all__ = ["CONFIG_SCHEMA", "DEFAULTS", "edition_settings", "enabled_sources", "job_parameters", "largest", "read_config", "story_queries"]


# Where a setting stands in the document.
PLACES = {"window_hours": "window_hours", "candidate_cap": "candidate_cap", "enrich_top": "enrich_top",
          "min_points": "hackernews.min_points", "models_limit": "huggingface_trending.limit",
          "repos_limit": "github_trending.limit", "pick": "github_trending.pick", "stories_enabled": "hackernews.enabled",
          "models_enabled": "huggingface_trending.enabled", "repos_enabled": "github_trending.enabled"}


def _scalars(config: DataFrame) -> list:
    return [(F.col(at) if at.split(".")[0] in config.columns else F.lit(None)).alias(c) for c, at in PLACES.items()]


def edition_settings(config: DataFrame, editions: DataFrame) -> DataFrame:
    """One row for each ``edition_date`` of ``editions`` with every scalar setting.
    Editions without a configuration, and settings that are missing, take ``DEFAULTS``."""
    days = editions.select("edition_date").distinct()
    if "edition_date" in config.columns:
        own = days.join(config.select("edition_date", *_scalars(config)).dropDuplicates(["edition_date"]), "edition_date", "left")
    else:  # one row, not data: its values are constants of the plan
        row = config.select(*_scalars(config)).first()
        own = days.select("edition_date", *(F.lit(row[c] if row else None).alias(c) for c in DEFAULTS))
    return own.select("edition_date", *(F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in DEFAULTS.items()))


def largest(settings: DataFrame) -> dict[str, int]:
    """The largest value of each number among the settings: what the bounded top-k
    steps need to know before they run. One row of maxima, at least 0."""
    names = [c for c, v in DEFAULTS.items() if not isinstance(v, bool)]
    row = settings.agg(*(F.max(c).alias(c) for c in names)).first()
    return {c: max(0, row[c] or 0) for c in names}


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """The configuration document as one row (explicit schema, never inferred)."""
    return spark.read.schema(CONFIG_SCHEMA).option("multiLine", True).json(path)


def story_queries(config: DataFrame) -> DataFrame:
    """The story-search queries in configuration order (``query_ordinal``
    from 1), or no rows when the story source is disabled."""
    day = [c for c in config.columns if c == "edition_date"]
    return (config.where(F.coalesce(F.col("hackernews.enabled"), F.lit(False)))
            .select(*day, F.posexplode("hackernews.queries").alias("query_ordinal", "query"))
            .select(*day, (F.col("query_ordinal") + 1).alias("query_ordinal"), "query"))


def job_parameters(config: DataFrame) -> dict:
    """The scalar settings the jobs take as arguments: window hours, candidate
    cap, enrich top, story minimum points, trending limit and pick, and which
    optional sources are enabled."""
    row = config.select(
        "window_hours", "candidate_cap", "enrich_top",
        F.col("hackernews.enabled").alias("stories_enabled"), F.col("hackernews.min_points").alias("min_points"),
        F.col("huggingface_trending.enabled").alias("models_enabled"),
        F.col("huggingface_trending.limit").alias("models_limit"),
        F.col("github_trending.enabled").alias("repos_enabled"), F.col("github_trending.since").alias("repos_since"),
        F.col("github_trending.limit").alias("repos_limit"), F.col("github_trending.pick").alias("pick")).first()
    return row.asDict() if row is not None else {}
