"""Edition documents: archive scan (S11) and edition writer (K1, K3).

Two layouts are read:

* ``files``: one pretty-printed JSON document per edition, named
  ``YYYY-MM-DD.json`` in one folder (what the daily job of the original
  tool leaves behind);
* ``partitioned``: what ``write_editions`` produces, JSON lines under
  ``edition_date=YYYY-MM-DD/`` folders, so a reader that filters on
  ``edition_date`` prunes whole folders.

Both use an explicit schema. Unreadable documents are dropped, as a bad or
missing file is ignored by the original reader.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.session import materialize

# ---------------------------------------------------------------------------
# The edition document schema and file naming.
SOCIAL = "struct<x: string, linkedin: string>"
ITEM = (f"struct<rank: int, category: string, title: string, summary: string, why_it_matters: string, "
        f"url: string, source: string, social: {SOCIAL}>")
REPO = f"struct<name: string, url: string, description: string, language: string, stars: bigint, social: {SOCIAL}>"
EDITION_SCHEMA = (f"date string, generated_at string, provider string, items array<{ITEM}>, "
                  f"repos array<{REPO}>, _corrupt_record string")
FILE_GLOB = "????-??-??.json"
FILE_NAME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\.json$"
# ---------------------------------------------------------------------------


def _fs_and_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_and_path(spark, path)
    return bool(fs.exists(p))


def _empty(spark: SparkSession, extra: str = "") -> DataFrame:
    schema = EDITION_SCHEMA.replace(", _corrupt_record string", "") + extra
    return spark.createDataFrame([], schema)


def read_edition_files(spark: SparkSession, folder: str) -> DataFrame:
    """S11 scan of the ``files`` layout: only names ``YYYY-MM-DD.json`` count
    (glob first, exact pattern on the file name after); a missing folder
    means no editions."""
    if not path_exists(spark, folder):
        return _empty(spark)
    df = (spark.read.schema(EDITION_SCHEMA).option("multiLine", True)
          .option("pathGlobFilter", FILE_GLOB).json(folder))
    return (df.where(F.col("_metadata.file_name").rlike(FILE_NAME))
            .where(F.col("_corrupt_record").isNull() & F.col("date").isNotNull())
            .drop("_corrupt_record"))


def read_editions(spark: SparkSession, folder: str) -> DataFrame:
    """Scan of the ``partitioned`` layout written by ``write_editions``; adds
    the ``edition_date`` partition column."""
    if not path_exists(spark, folder):
        return _empty(spark, ", edition_date date")
    schema = EDITION_SCHEMA.replace(", _corrupt_record string", "") + ", edition_date date"
    return spark.read.schema(schema).json(folder)


def published_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Edition dates already written, from the folder names alone (a listing,
    no file is opened)."""
    if not path_exists(spark, folder):
        return spark.createDataFrame([], "edition_date date")
    fs, p = _fs_and_path(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    dates = [n.split("=", 1)[1] for n in names if n.startswith("edition_date=")]
    return spark.createDataFrame([(d,) for d in dates], "d string").select(
        F.to_date("d").alias("edition_date"))


# A writer's claims, one file for each edition, and what it has not yet moved into
# place; readers skip these names.
CLAIMS, STAGING = "_claims", "_staging"
STALE_SECONDS = 6 * 3600


def _create(spark: SparkSession, path: str) -> bool:
    """Create an empty file unless it is there, in one step that only one of several
    writers can win."""
    fs, p = _fs_and_path(spark, path)
    fs.mkdirs(p.getParent())
    jvm = spark.sparkContext._jvm
    if fs.getUri().getScheme() == "file":  # Hadoop's local file system looks first and creates then
        return bool(jvm.java.io.File(p.toUri().getPath()).createNewFile())
    try:
        fs.create(p, False).close()
        return True
    except Exception as e:
        if fs.exists(p):
            return False
        raise e


def claim(spark: SparkSession, folder: str, day: dt.date, stale_seconds: int = STALE_SECONDS) -> bool:
    """K3 for several writers: may this one write the edition of ``day``? A claim left
    behind by a writer that died is taken over after ``stale_seconds``: it is
    moved away, which only one writer can do, and made anew."""
    path = f"{folder.rstrip('/')}/{CLAIMS}/{day.isoformat()}"
    if _create(spark, path):
        return True
    fs, p = _fs_and_path(spark, path)
    try:
        age = time.time() - fs.getFileStatus(p).getModificationTime() / 1000
    except Exception:  # released just now: whoever claims it next may write
        return _create(spark, path)
    if age <= stale_seconds:
        return False
    aside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{CLAIMS}/.stale-{uuid.uuid4().hex}")
    return bool(fs.rename(p, aside)) and _create(spark, path)


def release(spark: SparkSession, folder: str, day: dt.date) -> None:
    fs, p = _fs_and_path(spark, f"{folder.rstrip('/')}/{CLAIMS}/{day.isoformat()}")
    fs.delete(p, False)


def _publish(fresh: DataFrame, folder: str) -> None:
    """Write into a folder of our own first (two jobs that commit into one folder
    remove each other's temporary files), then move each edition's folder into
    place whole."""
    spark = fresh.sparkSession
    aside = f"{folder.rstrip('/')}/{STAGING}-{uuid.uuid4().hex}"
    fresh.repartition("edition_date").write.partitionBy("edition_date").json(aside)
    fs, staged = _fs_and_path(spark, aside)
    for s in fs.listStatus(staged):
        name = s.getPath().getName()
        if name.startswith("edition_date=") and not fs.rename(s.getPath(), _fs_and_path(spark, f"{folder.rstrip('/')}/{name}")[1]):
            raise OSError(f"{name} could not be moved to {folder}")
    fs.delete(staged, True)


def write_editions(editions: DataFrame, folder: str, stale_seconds: int = STALE_SECONDS) -> DataFrame:
    """K1 + K3: append the editions that are not published yet, one folder per
    ``edition_date``; an existing edition is never rewritten, also not when two
    writers run at once: each edition is claimed before, and only its claimant
    writes. Claims go when the write has ended, well or not.

    ``editions`` holds one row per edition with ``edition_date`` and the
    document fields; it is computed once. Rows are clustered by ``edition_date``
    so each edition lands in one file, and its folder appears whole. The dates (not
    the editions) pass the driver. Returns the editions that were written, read back.
    """
    spark = editions.sparkSession
    cols = ["date", "generated_at", "provider", "items", "repos", "edition_date"]
    fresh = materialize(editions.join(published_dates(spark, folder), "edition_date", "left_anti").select(*cols))
    days = [r[0] for r in fresh.select("edition_date").distinct().collect()]
    mine = [d for d in days if claim(spark, folder, d, stale_seconds)]
    try:
        # Another writer may have published between the first look and the claim.
        done = {r[0] for r in published_dates(spark, folder).collect()}
        todo = [d for d in mine if d not in done]
        if todo:
            _publish(fresh.where(F.col("edition_date").isin(todo)), folder)
    finally:
        for d in mine:
            release(spark, folder, d)
    return read_editions(spark, folder).where(F.col("edition_date").isin(todo)).select(*cols)
