"""Registered streaming queries (ST1–ST7): each runs a Structured Streaming
query to completion (``availableNow``) over observation slices derived from
the test tables and returns the sink contents as a DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riselens.plans.registry import register, round_sql, rounded
from riselens.sources import fixtures as fx
from riselens.session import ensure_checkpoint_dir
from riselens.streaming import fixtures as SF
from riselens.streaming import ladder as L

_SLICES: dict = {}


def _input(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SLICES:
        _SLICES[key] = SF.write_slices(spark, sf)
    return _SLICES[key]


def _run(spark, sf, build, output_mode="append"):
    inp, _ = _input(spark, sf)
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"
    src = (spark.readStream.schema(L.OBS_SCHEMA).option("maxFilesPerTrigger", 1)
           .option("recursiveFileLookup", "true").parquet(inp))
    q = L.start(build(src), f"{root}/out", f"{root}/ck", "availableNow", "parquet", output_mode)
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out")


_OBS = {"obs": """SELECT s.post_id, p.subreddit, p.created_timestamp, s.snapshot_time, s.score, s.upvote_ratio,
    s.num_comments FROM snapshots s JOIN posts p USING (post_id)"""}
_WINDOWS = [(0, "-1e300", "1e300")] + [(m, f"{m} - 2.0", f"{m} + 120.0") for m in (5, 15, 30, 60)]
_LADDER_SQL = " UNION ALL ".join(f"""
SELECT post_id, subreddit, CAST({m} AS INTEGER) AS interval_minutes, {round_sql('snapshot_time')} AS snapshot_time,
  {round_sql('greatest(age, 0.0)' if m == 0 else 'age')} AS post_age_minutes, {round_sql('score')} AS score,
  {round_sql('upvote_ratio')} AS upvote_ratio, {round_sql('num_comments')} AS num_comments
FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY snapshot_time) AS rn
      FROM (SELECT o.*, (o.snapshot_time - c.created) / 60.0 AS age FROM obs o
            JOIN (SELECT post_id, min(created_timestamp) AS created FROM obs GROUP BY post_id) c USING (post_id))
      WHERE age >= {lo} AND age <= {hi}) WHERE rn = 1""" for m, lo, hi in _WINDOWS)
_LADDER_ORACLE = fx.sql_with(f"SELECT * FROM ({_LADDER_SQL})", "posts", "snapshots", extra=_OBS)
_STREAM_ORACLE = fx.sql_with(f"""SELECT * FROM ({_LADDER_SQL})
WHERE snapshot_time <= (SELECT max(snapshot_time) FROM obs) - 1800""", "posts", "snapshots", extra=_OBS)
_HOURLY_ORACLE = fx.sql_with(f"""
SELECT subreddit, hour_start, count(*) AS observations, {round_sql('avg(score)')} AS mean_score FROM (
  SELECT subreddit, score, date_trunc('hour', make_timestamp(CAST(round(snapshot_time * 1000000) AS BIGINT))) AS hour_start,
         snapshot_time FROM obs)
WHERE epoch(hour_start) + 3600 <= (SELECT max(snapshot_time) FROM obs) - 1800
GROUP BY subreddit, hour_start""", "posts", "snapshots", extra=_OBS)


@register("stream_snapshot_ladder", _STREAM_ORACLE)
def q_stream_ladder(spark, sf):
    return rounded(_run(spark, sf, L.ladder_stream))


@register("stream_first_sight_posts")
def q_stream_first_sight(spark, sf):
    df = _run(spark, sf, L.first_sight_posts)
    return rounded(df.select("post_id", "subreddit", "created_timestamp", "snapshot_time"))


@register("stream_hourly_counts", _HOURLY_ORACLE)
def q_stream_hourly(spark, sf):
    df = _run(spark, sf, L.hourly_counts)
    # hour_start as a UTC wall-clock timestamp without zone (the oracle's type)
    return rounded(df.withColumn("hour_start", F.col("hour_start").cast("timestamp_ntz")))


@register("batch_snapshot_ladder", _LADDER_ORACLE)
def q_batch_ladder(spark, sf):
    """The batch twin of the stream ladder over the same observations."""
    return rounded(L.ladder_batch(SF.observations(spark, sf)))
