"""Landed API answers -> rows.

An outside loader lands each answer as it came back: one story-search answer
per (run, query), one trending-model list per run, one model reply per call.
Every reader takes an explicit schema (never inferred) and unpacks arrays with
``posexplode``, so an answer never leaves its task and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Landed schemas and the trending-model item templates.
HIT_SCHEMA = ("array<struct<title: string, url: string, points: bigint, created_at_i: bigint, "
              "objectID: string>>")
STORY_ANSWER_SCHEMA = ("edition_date date, as_of timestamp, query string, query_ordinal int, "
                       f"hits {HIT_SCHEMA}")
MODEL_SCHEMA = "array<struct<id: string, modelId: string, downloads: bigint, likes: bigint, lastModified: string>>"
MODEL_ANSWER_SCHEMA = f"edition_date date, as_of timestamp, models {MODEL_SCHEMA}"
RESPONSE_SCHEMA = ("edition_date date, call_kind string, key string, attempt int, raw string, landed_at timestamp, "
                   "_corrupt_record string")
MODEL_TITLE = "Modelo en tendencia: "
MODEL_SNIPPET_DOWNLOADS = "Descargas: "
MODEL_SNIPPET_LIKES = ", likes: "
MODEL_UNKNOWN_COUNT = "?"
MODEL_URL = "https://huggingface.co/"
MODEL_SOURCE = "Hugging Face (trending)"
CHAT_PROVIDER = "deepseek"
CLI_PROVIDER = "claude-code"
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def read_story_answers(spark: SparkSession, path: str) -> DataFrame:
    """S3 scan: landed story-search answers (JSON lines, one answer per run and
    query). A file that does not parse gives a row with null ``hits``."""
    return spark.read.schema(STORY_ANSWER_SCHEMA).json(path)


def story_hit_rows(answers: DataFrame, by: tuple[str, ...] = ("edition_date",)) -> DataFrame:
    """S3 + P6 input: one row per hit, in answer order.

    Output: ``*by, as_of, query, query_ordinal, hit_id, title, url, points,
    created`` where ``hit_id`` is the hit's position in its answer (the API
    sends newest first) and ``created`` is the epoch-second time as a
    timestamp. A query whose answer failed (null ``hits``) gives no rows; it
    is skipped, not fatal.
    """
    e = answers.select(*by, "as_of", "query", "query_ordinal", F.posexplode("hits").alias("hit_id", "h"))
    return e.select(*by, "as_of", "query", "query_ordinal", "hit_id",
                    F.col("h.title").alias("title"), F.col("h.url").alias("url"),
                    F.col("h.points").alias("points"),
                    F.timestamp_seconds(F.col("h.created_at_i")).alias("created"))


def read_model_answers(spark: SparkSession, path: str) -> DataFrame:
    """S4 scan: landed trending-model lists (JSON lines, one list per run)."""
    return spark.read.schema(MODEL_ANSWER_SCHEMA).json(path)


def model_items(answers: DataFrame, by: tuple[str, ...] = ("edition_date",)) -> DataFrame:
    """Trending-model lists -> news items, in list order (``item_ordinal``)."""
    e = answers.select(*by, "as_of", F.posexplode("models").alias("item_ordinal", "m"))
    return model_rows(e.select(*by, "as_of", (F.col("item_ordinal") + 1).alias("item_ordinal"), "m.*"), by)


def model_rows(models: DataFrame, by: tuple[str, ...] = ("edition_date",)) -> DataFrame:
    """S4 on one row per model (``id, modelId, downloads, likes, lastModified,
    item_ordinal, as_of``).

    The id is ``id``, else ``modelId`` (only a missing value falls through, an
    empty one does not); models without an id are dropped. Missing counts
    print ``?``; a missing date becomes the run's ``as_of``, an unreadable one
    is null (sorted last, trap 6). No time window applies to this source.
    """
    mid = F.coalesce(F.col("id"), F.col("modelId"), F.lit(""))

    def count(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(MODEL_UNKNOWN_COUNT))

    return (models.withColumn("_id", mid).where(F.col("_id") != "")
            .select(*by, "as_of", "item_ordinal",
                    F.concat(F.lit(MODEL_TITLE), F.col("_id")).alias("title"),
                    F.concat(F.lit(MODEL_SNIPPET_DOWNLOADS), count("downloads"),
                             F.lit(MODEL_SNIPPET_LIKES), count("likes")).alias("snippet"),
                    F.concat(F.lit(MODEL_URL), F.col("_id")).alias("url"),
                    F.lit(MODEL_SOURCE).alias("source"),
                    F.when(F.col("lastModified").isNull(), F.col("as_of"))
                    .otherwise(F.try_to_timestamp(F.col("lastModified"))).alias("published_at"),
                    F.lit(None).cast("bigint").alias("points")))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """S9 scan: landed model answers (JSON lines, one for each call and attempt).
    Lines that do not parse stay, in ``_corrupt_record``, with null fields; see
    ``good_responses``."""
    return spark.read.schema(RESPONSE_SCHEMA).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def good_responses(responses: DataFrame) -> DataFrame:
    """The readable rows of ``read_responses`` that name their call."""
    return responses.where(F.col("_corrupt_record").isNull() & F.col("edition_date").isNotNull() & F.col("attempt").isNotNull()).drop("_corrupt_record")


def unwrap_chat(raw) -> Column:
    """S10, chat API: the text at ``choices[0].message.content``; null (a failed
    call) when the envelope is not JSON or the text is missing, empty or not
    a string."""
    v = F.try_parse_json(_c(raw))
    node = F.try_variant_get(v, "$.choices[0].message.content", "variant")
    text = F.variant_get(node, "$", "string")
    return F.when((F.schema_of_variant(node) == "STRING") & (text != ""), text)


def unwrap_cli(raw) -> Column:
    """S10, command-line tool: a non-JSON reply passes through as it is; else
    ``structured_output`` when present (even a JSON null) as JSON text, else a
    string ``result``, else the whole envelope.

    The whole envelope is returned as received: it parses to the same value as
    a re-serialisation and keeps the key order. ``structured_output`` is
    re-serialised from VARIANT, which lists object keys in sorted order; every
    consumer parses the text again, so key order carries no meaning there.
    """
    r = _c(raw)
    v = F.try_parse_json(r)
    structured = F.try_variant_get(v, "$.structured_output", "variant")
    result = F.try_variant_get(v, "$.result", "variant")
    return (F.when(v.isNull(), r)
            .when(structured.isNotNull(), F.to_json(structured))
            .when(F.schema_of_variant(result) == "STRING", F.variant_get(result, "$", "string"))
            .otherwise(r))


def unwrap_answer(raw, provider) -> Column:
    """S10 by provider name (already resolved with P8)."""
    return F.when(_c(provider) == CLI_PROVIDER, unwrap_cli(raw)).otherwise(unwrap_chat(raw))
