"""J-INGEST + J-RANK as a stream: candidates built while items land.

Mapped items (the ``collected`` shape plus the run instant ``as_of``) land as
parquet files during the day. The A1 merge is a streaming aggregate keyed by
``(as_of, edition_date, canonical url)`` with a watermark on ``as_of``: a
run's merged rows stay in the state store until the watermark passes the run
instant, then they are emitted once (append mode) and the state is dropped.
An item that lands twice (a replayed file, a loader that was restarted) is taken once:
duplicates of run, canonical URL and arrival number are dropped while the watermark
still admits them. All rows of one run leave in the same micro-batch, so ``foreachBatch`` can
rank them exactly (T1) and write them to a table partitioned by ``as_of`` and
``edition_date``. A run is emitted once a run later than it by the lateness has
landed; items that land after that are left to the batch job (``late_rows`` counts
them).

State is one row per (run, URL), bounded by what one run collects. The
stream's checkpoint lives under the shared ``spark.checkpoint.dir``, so a
restarted query (or one whose executors were lost) resumes from its last
committed batch. The last batch may then run a second time: it overwrites the
partitions of its own runs, so no row appears twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from broadsheet.functions.text import canonical_url
from broadsheet.operators.dedup import CANDIDATE_CAP, merge_items, rank_per_edition
from broadsheet.session import checkpoint_dir

# ---------------------------------------------------------------------------
# Landed item schema and how late an item of a run may land.
LANDED_SCHEMA = ("as_of timestamp, edition_date date, seq bigint, title string, snippet string, url string, "
                 "source string, published_at timestamp, points bigint")
DEFAULT_LATENESS = "1 hour"
# ---------------------------------------------------------------------------


def read_landed(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Streaming scan of landed item files (explicit schema, never inferred)."""
    r = spark.readStream.schema(LANDED_SCHEMA)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(folder)


def distinct_items(items: DataFrame, lateness: str = DEFAULT_LATENESS) -> DataFrame:
    """Every landed item once: run, edition, canonical URL and arrival number name it.
    The state survives restarts and is dropped behind the watermark."""
    keyed = items.withWatermark("as_of", lateness).withColumn("__key", canonical_url(F.col("url")))
    return keyed.dropDuplicatesWithinWatermark(["as_of", "edition_date", "__key", "seq"])


def late_rows(query: StreamingQuery) -> int:
    """Rows that the reported micro-batches left out because their run had closed."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def merged_stream(items: DataFrame, lateness: str = DEFAULT_LATENESS) -> DataFrame:
    """A1 on a stream: exactly ``merge_items`` (same aggregates), grouped by
    run as well, and finalised when the watermark on ``as_of`` passes the run."""
    return merge_items(distinct_items(items, lateness), F.col("__key"), by=("as_of", "edition_date"))


def write_batch(batch: DataFrame, output: str, cap: int = CANDIDATE_CAP) -> None:
    """Rank per run (two runs of one edition may close in the same batch) and
    replace the partitions of these runs. A run closes in one batch, so its
    partitions are whole and a replay writes the same rows again."""
    ranked = rank_per_edition(batch, cap=cap, by=("as_of", "edition_date"))
    (ranked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("as_of", "edition_date").parquet(output))


def start_candidates_stream(spark: SparkSession, landing: str, output: str, name: str = "candidates",
                            cap: int = CANDIDATE_CAP, lateness: str = DEFAULT_LATENESS,
                            available_now: bool = False) -> StreamingQuery:
    """Run the stream: merged runs are ranked per batch and written to
    ``output`` (parquet, partitioned by ``as_of`` and ``edition_date``)."""
    w = (merged_stream(read_landed(spark, landing), lateness).writeStream
         .outputMode("append").foreachBatch(lambda batch, _: write_batch(batch, output, cap))
         .option("checkpointLocation", f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
