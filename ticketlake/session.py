"""Session helpers.

The cluster owns its configuration; these helpers only fill in what is unset
(tests and local benches), never override what the cluster already names.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings we want for every run, applied only when the session has no value.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "ticketlake") -> SparkSession:
    """Return the active session, or build a local one for tests/benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        apply_defaults(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master or os.environ.get("TICKETLAKE_MASTER", "local[8]"))
    builder = builder.config("spark.ui.enabled", "false")
    builder = builder.config("spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.driver.memory", os.environ.get("TICKETLAKE_DRIVER_MEM", "8g"))
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_defaults(spark: SparkSession) -> None:
    """Fill in our defaults where the session leaves them unset."""
    for k, v in _DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    A local session that names none (tests) gets a scratch folder.  On a cluster that would be
    a folder which other machines cannot see, so there an unset folder is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="ticketlake-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def stored(df):
    """``df`` written as a compressed table into the shared checkpoint folder and read back: a checkpoint of long
    texts would take several times the disk."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan):
    """Deal out a scan of one single file, which may be one row group and so one task.

    Only for plain scans: the list of files is known without a job.  Tables of several files
    are returned as they are.
    """
    if len(scan.inputFiles()) == 1:
        return scan.repartition(scan.sparkSession.sparkContext.defaultParallelism)
    return scan


# Bytes of an Arrow batch that goes to a worker, where the session sets no bound.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds the bytes of Arrow batches, as rows of texts have any length."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, None) or 0) <= 0 or int(spark.conf.get(name)) >= (1 << 31) - 1:
        spark.conf.set(name, str(BATCH_BYTES))
