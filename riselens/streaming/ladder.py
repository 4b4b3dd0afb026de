"""Structured Streaming form of the snapshot collector (ST1–ST7).

Input: a stream of observations (post_id, subreddit, created_timestamp,
snapshot_time, score, upvote_ratio, num_comments) with event time
``snapshot_time``.

* ST1 ``first_sight_posts``: watermark + ``dropDuplicatesWithinWatermark``.
* ST2/ST3 ``ladder_stream``: keyed state per group of posts (a hash of the id;
  ``applyInPandasWithState``) holding, for every post, interval 0 (first
  sight) and every ladder interval m, the earliest observation whose age is in
  ``[m - tolerance, m + grace]``.  A
  candidate is emitted once the watermark has passed its event time — no
  earlier observation can arrive after that (it would be late) — so the
  output does not depend on arrival order within the watermark delay and
  equals ``ladder_batch``.  One late observation may satisfy several
  intervals (studied behaviour, kept).  A finished post stays in the state
  until the watermark has passed its prune horizon, created + (last interval +
  grace) (event-time timer, D10): later observations of it are recognised until
  then, and rows beyond the horizon are ignored, so no ladder starts twice.
* ST4: rows older than the watermark are ignored by the state function.
* ST5/ST6: triggers (``availableNow`` / processing time) and restart from the
  checkpoint location are plain ``writeStream`` options.
* ST7 ``hourly_counts``: tumbling one-hour windows per community.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riselens.operators.snapshots import DEFAULT_INTERVALS, GRACE_MINUTES, TOLERANCE_MINUTES

OBS_SCHEMA = T.StructType([
    T.StructField("post_id", T.StringType()),
    T.StructField("subreddit", T.StringType()),
    T.StructField("created_timestamp", T.DoubleType()),
    T.StructField("snapshot_time", T.DoubleType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("upvote_ratio", T.DoubleType()),
    T.StructField("num_comments", T.DoubleType()),
])
OUT_SCHEMA = T.StructType([
    T.StructField("post_id", T.StringType()),
    T.StructField("subreddit", T.StringType()),
    T.StructField("interval_minutes", T.IntegerType()),
    T.StructField("snapshot_time", T.DoubleType()),
    T.StructField("post_age_minutes", T.DoubleType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("upvote_ratio", T.DoubleType()),
    T.StructField("num_comments", T.DoubleType()),
])
_FIELDS = ["t", "score", "ratio", "comments"]
_READ = ["snapshot_time", "created_timestamp", "score", "upvote_ratio", "num_comments"]
_STATE_SCHEMA = T.StructType([T.StructField("posts", T.BinaryType())])
#: Posts share a state and a Python call, which costs some ms however many they are.  Part of the
#: state's key: another number needs a new checkpoint.  A group's followed posts must fit one worker.
STATE_GROUPS = 2048


def with_event_time(obs: DataFrame) -> DataFrame:
    return obs.withColumn("event_ts", F.timestamp_micros(F.round(F.col("snapshot_time") * 1_000_000).cast("long")))


def first_sight_posts(obs: DataFrame, delay: str = "3 hours") -> DataFrame:
    """ST1: one row per post (its first arrival) within the watermark horizon."""
    return with_event_time(obs).withWatermark("event_ts", delay).dropDuplicatesWithinWatermark(["post_id"])


def _horizon(intervals: Sequence[int], grace: float) -> float:
    """Age in minutes beyond which a post is no longer followed."""
    return max(intervals, default=0) + grace


class _Posts:
    """The followed posts of one state group: created time, and per slot the earliest due observation or NaN."""

    def __init__(self, slots: int, stored: bytes | None = None):
        if stored is None:
            self.ids, self.subs, self.created = np.empty(0, object), np.empty(0, object), np.empty(0)
            self.found, self.done = np.empty((0, slots, len(_FIELDS))), np.empty((0, slots), bool)
            return
        b = pa.ipc.open_stream(pa.py_buffer(bytes(stored))).read_next_batch()
        self.ids, self.subs = (b.column(c).to_numpy(zero_copy_only=False) for c in ("post_id", "subreddit"))
        self.created = b.column("created").to_numpy().copy()
        self.found = np.stack([b.column(f"s{i}_{f}").to_numpy() for i in range(slots) for f in _FIELDS], 1).reshape(-1, slots, len(_FIELDS))
        self.done = np.stack([b.column(f"s{i}_done").to_numpy(zero_copy_only=False) for i in range(slots)], 1)

    def stored(self) -> bytes:
        cols = {"post_id": pa.array(self.ids, pa.string()), "subreddit": pa.array(self.subs, pa.string()), "created": pa.array(self.created)}
        for i in range(self.done.shape[1]):
            cols |= {f"s{i}_{f}": pa.array(self.found[:, i, k]) for k, f in enumerate(_FIELDS)}
            cols[f"s{i}_done"] = pa.array(self.done[:, i])
        batch, sink = pa.record_batch(cols), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes()

    def keep(self, which: np.ndarray) -> None:
        self.ids, self.subs, self.created, self.found, self.done = (
            x[which] for x in (self.ids, self.subs, self.created, self.found, self.done))

    def follow(self, ids: np.ndarray, subs: np.ndarray, created: np.ndarray) -> np.ndarray:
        """Add posts not yet known and lower created times; the rows' positions among the posts."""
        n = len(self.ids)
        codes, _ = pd.factorize(np.concatenate([self.ids, ids]), use_na_sentinel=False)
        codes = codes[n:]
        new, first = np.unique(codes, return_index=True)
        first = first[new >= n]
        m, slots = len(first), self.done.shape[1]
        self.ids, self.subs = np.concatenate([self.ids, ids[first]]), np.concatenate([self.subs, subs[first]])
        self.created = np.concatenate([self.created, np.full(m, np.inf)])
        self.found = np.concatenate([self.found, np.full((m, slots, len(_FIELDS)), np.nan)])
        self.done = np.concatenate([self.done, np.zeros((m, slots), bool)])
        np.minimum.at(self.created, codes, created)
        return codes


def _ladder_fn(intervals: Sequence[int], tolerance: float, grace: float):
    slots = [0, *intervals]
    horizon = _horizon(intervals, grace)
    lows = np.array([-np.inf] + [m - tolerance for m in intervals])
    highs = np.array([horizon] + [m + grace for m in intervals])

    def fn(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        wm = state.getCurrentWatermarkMs() / 1000.0
        posts = _Posts(len(slots), state.get[0] if state.exists else None)
        for pdf in pdfs:
            t, created, *rest = (pdf[c].to_numpy(dtype=np.float64) for c in _READ)
            # beyond the prune horizon (of a post's constant created time) nothing is due, nor a new post begun
            kept = t - created <= horizon * 60.0
            if wm > 0:
                kept &= t >= wm                                          # ST4: late rows ignored
            if not kept.any():
                continue
            ids, subs = (pdf[c].to_numpy(dtype=object)[kept] for c in ("post_id", "subreddit"))
            at = posts.follow(ids, subs, created[kept])
            seen = np.stack([x[kept] for x in (t, *rest)], 1)
            age = (seen[:, 0] - posts.created[at]) / 60.0
            for i in range(len(slots)):
                due = np.nonzero(~posts.done[at, i] & (age >= lows[i]) & (age <= highs[i]))[0]
                due = due[np.lexsort((seen[due, 0], at[due]))]
                due = due[np.diff(at[due], prepend=-1) != 0]               # each post's earliest due observation of this batch
                before = posts.found[at[due], i, 0]
                due = due[np.isnan(before) | (seen[due, 0] < before)]
                posts.found[at[due], i] = seen[due]
        if not len(posts.ids):
            return
        found_at, close = posts.found[:, :, 0], posts.created[:, None] + highs * 60.0
        ready = ~posts.done & (found_at <= wm)
        closed = ~posts.done & np.isnan(found_at) & (close < wm)           # window closed without a snapshot
        posts.done |= ready | closed
        p, i = np.nonzero(ready)
        if len(p):
            hit = posts.found[p, i]
            age = (hit[:, 0] - posts.created[p]) / 60.0
            out = [posts.ids[p], posts.subs[p], np.array(slots, np.int32)[i], hit[:, 0], np.where(i == 0, np.maximum(age, 0.0), age), *hit.T[1:]]
            yield pd.DataFrame(dict(zip((f.name for f in OUT_SCHEMA.fields), out)))
        # a post is known until all its slots are done and the watermark has passed its prune horizon
        wait = np.where(posts.done, np.inf, np.where(np.isnan(found_at), close, found_at)).min(axis=1)
        forget = posts.created + horizon * 60.0
        live = np.isfinite(wait) | (forget >= wm)
        if not live.any():
            state.remove()
            return
        posts.keep(live)
        state.update((posts.stored(),))
        state.setTimeoutTimestamp(int(np.where(np.isfinite(wait), wait, forget)[live].min() * 1000) + 1)

    return fn


def ladder_stream(obs: DataFrame, intervals: Sequence[int] = DEFAULT_INTERVALS, tolerance: float = TOLERANCE_MINUTES,
                  grace: float = GRACE_MINUTES, delay: str = "30 minutes") -> DataFrame:
    """ST2/ST3: ladder rows (interval 0 = first sight, then each interval)."""
    src = with_event_time(obs).withWatermark("event_ts", delay).withColumn("_group", F.pmod(F.xxhash64("post_id"), F.lit(STATE_GROUPS)))
    return src.groupBy("_group").applyInPandasWithState(
        _ladder_fn(list(intervals), tolerance, grace), OUT_SCHEMA, _STATE_SCHEMA, "append",
        GroupStateTimeout.EventTimeTimeout)


def ladder_batch(obs: DataFrame, intervals: Sequence[int] = DEFAULT_INTERVALS, tolerance: float = TOLERANCE_MINUTES,
                 grace: float = GRACE_MINUTES) -> DataFrame:
    """The same rows from a static table: per post and interval the earliest
    observation in the interval's age window (interval 0: the earliest within
    the prune horizon)."""
    created = obs.groupBy("post_id").agg(F.min("created_timestamp").alias("_created"))   # partial aggregate
    o = obs.join(created, "post_id").withColumn("_age", (F.col("snapshot_time") - F.col("_created")) / 60.0)
    row = F.struct("snapshot_time", "_age", "score", "upvote_ratio", "num_comments")
    aggs = []
    for m in [0, *intervals]:
        until = m + grace if m else _horizon(intervals, grace)
        cond = ((F.col("_age") >= m - tolerance) | F.lit(m == 0)) & (F.col("_age") <= until)
        aggs.append(F.min_by(F.when(cond, row), F.when(cond, F.col("snapshot_time"))).alias(f"r{m}"))
    g = o.groupBy("post_id").agg(F.first("subreddit").alias("subreddit"), *aggs)
    items = F.array(*[F.struct(F.lit(m).alias("interval_minutes"), F.col(f"r{m}").alias("r")) for m in [0, *intervals]])
    ex = g.select("post_id", "subreddit", F.explode(items).alias("it")).filter(F.col("it.r").isNotNull())
    age = F.col("it.r._age")
    return ex.select(
        "post_id", "subreddit", F.col("it.interval_minutes").cast("int").alias("interval_minutes"),
        F.col("it.r.snapshot_time").alias("snapshot_time"),
        F.when(F.col("it.interval_minutes") == 0, F.greatest(age, F.lit(0.0))).otherwise(age).alias("post_age_minutes"),
        F.col("it.r.score").alias("score"), F.col("it.r.upvote_ratio").alias("upvote_ratio"),
        F.col("it.r.num_comments").alias("num_comments"))


def hourly_counts(obs: DataFrame, delay: str = "30 minutes") -> DataFrame:
    """ST7: observations and mean score per community and tumbling hour."""
    src = with_event_time(obs).withWatermark("event_ts", delay)
    return src.groupBy("subreddit", F.window("event_ts", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("observations"), F.avg("score").alias("mean_score")).select(
        "subreddit", F.col("w.start").alias("hour_start"), "observations", "mean_score")


def start(query_df: DataFrame, path: str, checkpoint: str, trigger: str = "availableNow",
          fmt: str = "parquet", output_mode: str = "append"):
    """ST5/ST6: start a sink; rerunning with the same checkpoint resumes."""
    w = query_df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode(output_mode)
    if trigger == "availableNow":
        w = w.trigger(availableNow=True)
    else:
        w = w.trigger(processingTime=trigger)
    return w.start()
