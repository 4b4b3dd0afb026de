"""Spark session defaults for the engine.

Everything here is a plain Spark setting: UTC session time, ANSI on, adaptive
query execution with partition coalescing, runtime broadcast conversion and
skew-join splitting.  On a cluster the session is created by the platform and
``configure`` only fills in settings that are still unset.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the engine relies on.  Applied with ``setdefault`` semantics so that
# a cluster's own choices (shuffle partitions sized for the data, broadcast
# thresholds) always win.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
    # Rows hold whole texts: what a Python worker gets at once is bounded by bytes.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    # A query's shuffle files go when it ends: results live in written tables.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply engine defaults without overriding explicit cluster settings."""
    conf = spark.conf
    for key, value in DEFAULTS.items():
        if conf.get(key, None) in (None, ""):
            conf.set(key, value)
    # Session time zone and ANSI are semantic, not tuning: always pin them.
    conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is used as is.
    Where it is unset, a local session (as in tests) gets a scratch folder, and
    any other master raises: executors would write to their own disks.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="riselens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "riselens") -> SparkSession:
    """Session for tests and local benchmarks (no UI, UTC, AQE)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("RISELENS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.worker.reuse", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint(df):
    """Cut lineage by writing a parquet table into the shared checkpoint folder.

    One computation of ``df`` (an RDD checkpoint computes its input twice),
    and later reads of the table get column pruning and filter pushdown.  The
    folder comes from ``spark.checkpoint.dir`` (shared storage on a cluster),
    so a lost executor never loses the materialised data.
    """
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/tables/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    # the schema is known: no job reads it from the files again
    table = spark.read.schema(df.schema).parquet(path)
    table._checkpoint_path = path
    return table


def drop_checkpoint(table) -> None:
    """Delete the files of a table that ``checkpoint`` returned.

    To be called when every frame that reads it is itself written: what comes
    later, also after the loss of an executor, starts from those tables.
    """
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._checkpoint_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
