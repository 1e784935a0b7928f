"""The corpus pipeline: quality, near duplicates, mixing, packing.

``run(spark, sf_dir)`` sends ``documents`` through the stages; each stage's result
is written as Parquet in the shared checkpoint folder and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from broadsheet.llm import mixing, neardup, quality
from broadsheet.llm.common import put_aside, put_back, written
from broadsheet.llm.queries import packed, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, does not reject. The
    labels are joined by ``doc_id``; without labelled documents all are kept."""
    scored = quality.score_documents(put_aside(docs, quality.MADE), table(spark, sf_dir, "labels"))
    return put_back(scored.where("predicted = 1"), docs.columns, quality.MADE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: the one with the smallest
    id. Of rows that repeat this id one stays; a group without ids keeps one row."""
    return neardup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix of its source takes it."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences."""
    return packed(docs)


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
