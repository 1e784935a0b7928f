"""Scans of the supplied parquet tables.

Each read names its columns so the parquet scan's ReadSchema only holds what a
job uses; filters written later are pushed into the scan by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """``df``'s rows dealt evenly to as many tasks as a shuffle has: for narrow rows
    that much work follows on. A scan makes a task for each row group at most, and a
    small file may be one row group."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
