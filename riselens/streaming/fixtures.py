"""Stream input built from the test tables: observation slices on disk.

Observations are the snapshot rows with their post's community and creation
time.  They are written as parquet slices in event-time order with a hashed
jitter below the watermark delay (so rows arrive out of order, but never
late), plus one final slice of rows older than the watermark (late data).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riselens.session import checkpoint, ensure_checkpoint_dir
from riselens.sources import fixtures as fx

SLICE_SECONDS = 3 * 86400.0
JITTER_SECONDS = 600.0          # below the 30-minute watermark delay
LATE_ROWS = 25


def observations(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.posts(spark, sf).select("post_id", "subreddit", "created_timestamp")
    s = fx.snapshots(spark, sf).select("post_id", "snapshot_time", "score", "upvote_ratio", "num_comments")
    return s.join(p, "post_id").select("post_id", "subreddit", "created_timestamp", "snapshot_time", "score",
                                       "upvote_ratio", "num_comments")


def write_slices(spark: SparkSession, sf: str, root: str | None = None) -> tuple[str, DataFrame]:
    """Write the slices; return (input folder, the on-time observations).

    Snapshots and posts are joined once, and the rows dealt to slices once; a
    slice is then one file, as a trigger takes one, copied from its own rows.
    """
    root = root or f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"
    obs = checkpoint(observations(spark, sf))
    t0 = obs.agg(F.min("snapshot_time")).collect()[0][0]
    jitter = (F.abs(F.xxhash64("post_id", "snapshot_time")) % 1000) / 1000.0 * JITTER_SECONDS
    sliced = obs.withColumn("_slice", F.floor((F.col("snapshot_time") - F.lit(t0) + jitter) / SLICE_SECONDS).cast("int"))
    n_slices = sliced.agg(F.max("_slice")).collect()[0][0] + 1
    sliced.write.mode("overwrite").partitionBy("_slice").parquet(f"{root}/dealt")
    dealt = spark.read.schema(sliced.schema).parquet(f"{root}/dealt")
    for i in range(n_slices):
        dealt.filter(F.col("_slice") == i).drop("_slice").coalesce(1).write.mode("overwrite").parquet(
            f"{root}/input/slice={i:04d}")
    # Late slice: copies of the earliest observations under fresh ids; they
    # are older than the watermark when they arrive and must be ignored.
    late = obs.orderBy("snapshot_time", "post_id").limit(LATE_ROWS).withColumn(
        "post_id", F.concat(F.lit("late_"), F.col("post_id")))
    late.coalesce(1).write.mode("overwrite").parquet(f"{root}/input/slice={n_slices:04d}")
    return f"{root}/input", obs
