"""Session helpers: the settings every job relies on, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs depend on for correct results (not tuning):
#  * UTC session zone, so civil dates are computed explicitly (F16) and
#    timestamps compare the same way in every engine;
#  * duplicate JSON keys keep the last value, as JSON.parse does.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Runtime re-planning: coalesce small shuffles, split skewed join partitions,
# and drop empty relations early. Safe at any scale.
ADAPTIVE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


# Sizing for large inputs. Shuffles start with enough partitions for about
# 128 MiB of input each and AQE merges them back to the advisory size, so the
# same job fits 1 GB and 100 TB; a partition over 5x the median and 256 MiB
# counts as skewed and is split at join time. Scans read 256 MiB splits.
TARGET_PARTITION_BYTES = 128 * 1024 * 1024
CLUSTER_CONF = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TARGET_PARTITION_BYTES),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * TARGET_PARTITION_BYTES),
    "spark.sql.files.maxPartitionBytes": str(2 * TARGET_PARTITION_BYTES),
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
}


MAX_SHUFFLE_PARTITIONS = 65536


def shuffle_partitions_for(input_bytes: int, minimum: int = 200) -> int:
    """Initial shuffle partitions for a job reading ``input_bytes``: one per
    128 MiB of input, at least ``minimum`` and at most 65,536 (more reducers
    would multiply shuffle blocks and map-status size). The jobs shuffle much
    less than they read (narrow projections, map-side merges, top-k before the
    exchange), and AQE coalesces small partitions and splits skewed ones at
    run time. 100 TB reaches the cap."""
    return min(MAX_SHUFFLE_PARTITIONS, max(minimum, -(-input_bytes // TARGET_PARTITION_BYTES)))


def build_session(master: str | None = None, app: str = "broadsheet",
                  shuffle_partitions: int | None = None, extra: dict | None = None,
                  input_bytes: int | None = None) -> SparkSession:
    """Create (or reuse) a session with the required settings.

    On a cluster pass ``master=None`` and let the launcher decide, plus the
    expected ``input_bytes`` to size shuffles (``CLUSTER_CONF``); locally
    pass ``local[N]``. The Spark UI stays off: no port is opened for it.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {**REQUIRED_CONF, **ADAPTIVE_CONF, "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false"}
    if input_bytes:
        conf.update(CLUSTER_CONF)
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions_for(input_bytes))
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    apply_required(spark)
    return spark


def apply_required(spark: SparkSession) -> SparkSession:
    """Apply the result-affecting settings to an existing session."""
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names it, since executors and the driver share no local folder:
    there an unset folder is an error. Only a local master (tests, local runs)
    gets a fresh scratch folder of its own.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not (sc.master or "").startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="broadsheet-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return local


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of a result that several later steps read: a reliable
    checkpoint in the shared checkpoint folder (survives lost executors, unlike
    a local checkpoint), read back as a plain scan."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
