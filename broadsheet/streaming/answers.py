"""The exchange with the language model as a stream.

Prompts and answers land as files, in any order. Every prompt waits for its answer
in a stream-stream outer join on the call and the attempt; an answer counts if it
landed within the time limit after the prompt was asked. What comes out is written
once for each micro-batch: answers, checked at once, and prompts that ran out of
time. Failed and unanswered attempts below the limit give the next prompt, which
lands with the others and is picked up by the next micro-batch.

State is what still waits, bounded by the time limit and the lateness; it lives
under the shared ``spark.checkpoint.dir``, so a restarted query goes on where it
was. A micro-batch that runs twice replaces its own files; a prompt or answer that
lands twice is taken once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from broadsheet.functions.prompts import digest_prompts
from broadsheet.operators import validate as V
from broadsheet.plans.daily import DIGEST_CALL, run_meta
from broadsheet.session import checkpoint_dir
from broadsheet.sources.landed import RESPONSE_SCHEMA

# ---------------------------------------------------------------------------
# The call's identity, the landed prompt, how long an answer may
# take (the model call's own limit is 300 s) and how late a file may land.
CALL = ["edition_date", "call_kind", "key", "attempt"]
PROMPT_SCHEMA = "edition_date date, call_kind string, key string, attempt int, prompt string, asked_at timestamp"
ANSWER_LIMIT = "5 minutes"
LATENESS = "10 minutes"
# ---------------------------------------------------------------------------


def read_prompt_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Landed prompts (Parquet); files of a folder of its own for each writer."""
    return spark.readStream.schema(PROMPT_SCHEMA).option("recursiveFileLookup", True).parquet(folder)


def read_response_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Landed answers (JSON lines), unreadable lines kept in ``_corrupt_record``."""
    return (spark.readStream.schema(RESPONSE_SCHEMA).option("columnNameOfCorruptRecord", "_corrupt_record")
            .option("recursiveFileLookup", True).json(folder))


def matched(prompts: DataFrame, responses: DataFrame, limit: str = ANSWER_LIMIT, lateness: str = LATENESS) -> DataFrame:
    """Prompts with the answer that landed in time (``raw``, ``landed_at``), or with
    nulls once none can come any more. Both inputs are streams."""
    p = prompts.withWatermark("asked_at", lateness).dropDuplicatesWithinWatermark(CALL)
    r = (responses.where(F.col("_corrupt_record").isNull()).select(*(F.col(c).alias(f"__{c}") for c in CALL), "raw", "landed_at")
         .withWatermark("landed_at", lateness).dropDuplicatesWithinWatermark([f"__{c}" for c in CALL]))
    same = F.lit(True)
    for c in CALL:
        same = same & (F.col(c) == F.col(f"__{c}"))
    in_time = (F.col("landed_at") >= F.col("asked_at")) & (F.col("landed_at") <= F.col("asked_at") + F.expr(f"INTERVAL {limit}"))
    return p.join(r, same & in_time, "leftOuter").select(*CALL, "prompt", "asked_at", "raw", "landed_at")


def settle(batch: DataFrame, number: int, output: str, prompts: str, candidates: DataFrame, runs: DataFrame, limit: str = ANSWER_LIMIT) -> None:
    """One micro-batch of ``matched``: checks the answers of the curation call, keeps all
    attempts under ``output`` and lands the next prompts."""
    spark = batch.sparkSession
    meta = run_meta(runs)
    done = batch.persist()
    try:
        inputs = candidates.groupBy("edition_date").agg(F.collect_list("url").alias("urls"))
        digest = done.where((F.col("call_kind") == DIGEST_CALL) & F.col("raw").isNotNull()).select("edition_date", "attempt", "raw")
        checked = V.check_attempts(digest, inputs, meta).select("edition_date", "attempt", "ok", "errors")
        table = (done.join(checked.withColumn("call_kind", F.lit(DIGEST_CALL)), ["edition_date", "call_kind", "attempt"], "left")
                 .select(*CALL, "prompt", "asked_at", "raw", "landed_at", "ok", "errors", F.col("raw").isNull().alias("timed_out")))
        table.write.mode("overwrite").parquet(f"{output.rstrip('/')}/batch={number}")
        settled = spark.read.parquet(f"{output.rstrip('/')}/batch={number}")
        again = V.retry_prompts(settled.where(~F.col("ok")).select("edition_date", "attempt", "ok", "errors"), digest_prompts(candidates, meta))
        asked = settled.where(~F.col("ok")).select("edition_date", (F.col("attempt") + 1).alias("attempt"), F.col("landed_at").alias("asked_at"))
        failed = again.join(asked, ["edition_date", "attempt"]).select(
            "edition_date", F.lit(DIGEST_CALL).alias("call_kind"), F.lit("").alias("key"), "attempt", "prompt", "asked_at")
        silent = settled.where(F.col("timed_out") & (F.col("attempt") < V.MAX_ATTEMPTS)).select(
            "edition_date", "call_kind", "key", (F.col("attempt") + 1).alias("attempt"), "prompt", (F.col("asked_at") + F.expr(f"INTERVAL {limit}")).alias("asked_at"))
        following = failed.unionByName(silent)
        if following.limit(1).count():
            following.write.mode("overwrite").parquet(f"{prompts.rstrip('/')}/after-{number}")
    finally:
        done.unpersist()


def read_attempts(spark: SparkSession, output: str) -> DataFrame:
    """All settled attempts: the call, its prompt, the answer, ``ok`` and ``errors`` of
    curation answers, ``timed_out``."""
    return spark.read.parquet(output).drop("batch")


def start_answer_stream(spark: SparkSession, prompts: str, responses: str, output: str, candidates: DataFrame, runs: DataFrame,
                        name: str = "answers", limit: str = ANSWER_LIMIT, lateness: str = LATENESS, available_now: bool = False) -> StreamingQuery:
    """Run the exchange. ``candidates`` and ``runs`` are the (static) outputs of
    ``prepare`` for the editions concerned."""
    w = (matched(read_prompt_stream(spark, prompts), read_response_stream(spark, responses), limit, lateness).writeStream.outputMode("append")
         .foreachBatch(lambda batch, n: settle(batch, n, output, prompts, candidates, runs, limit))
         .option("checkpointLocation", f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
