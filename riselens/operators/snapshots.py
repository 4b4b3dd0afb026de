"""Snapshot ladder (J2, D1–D6) and batch tracking-state operators.

The nearest-time match is one hash aggregate: for every target age ``m`` the
score of the snapshot minimising ``(|age - m|, tie_key)`` via ``min_by``.
``min_by`` is partially aggregated before the shuffle, so a post with many
observations never travels as a group.  The ladder is then joined to the posts
on ``post_id`` (both sides hash-partitioned on the key; no extra exchange when
the posts were deduplicated on the same key).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_TARGETS = (5, 15, 30, 60)


def ladder_scores(
    snapshots: DataFrame,
    targets: Sequence[int] = DEFAULT_TARGETS,
    tie_key: str = "event_id",
    max_gap: float | None = None,
    key: str = "post_id",
    age: str = "post_age_minutes",
    score: str = "score",
) -> DataFrame:
    """Per post: score of the nearest snapshot for each target age."""
    aggs = []
    for m in targets:
        dist = F.abs(F.col(age) - F.lit(float(m)))
        order = F.struct(dist.alias("d"), F.col(tie_key).alias("t"))
        if max_gap is not None:
            order = F.when(dist <= F.lit(float(max_gap)), order)
        aggs.append(F.min_by(F.col(score).cast("double"), order).alias(f"score_at_{m}min"))
    aggs.append(F.count(F.lit(1)).alias("n_snapshots"))
    return snapshots.groupBy(key).agg(*aggs)


def snapshot_ladder(
    posts: DataFrame,
    snapshots: DataFrame,
    targets: Sequence[int] = DEFAULT_TARGETS,
    tie_key: str = "event_id",
    max_gap: float | None = None,
    key: str = "post_id",
    fallback: str = "score",
) -> DataFrame:
    """Attach ``score_at_{m}min`` to posts; no snapshot -> final score.

    Posts without any snapshot take their final score for every rung (the
    studied behaviour, audited later); ``has_snapshot`` marks them.
    """
    lad = ladder_scores(snapshots, targets, tie_key, max_gap, key)
    j = posts.join(lad, key, "left")
    cols = {f"score_at_{m}min": F.coalesce(F.col(f"score_at_{m}min"), F.col(fallback).cast("double")) for m in targets}
    cols["has_snapshot"] = F.col("n_snapshots").isNotNull().cast("int")
    return j.withColumns(cols).drop("n_snapshots")


def dynamics(targets: Sequence[int] = DEFAULT_TARGETS) -> dict[str, Column]:
    """D2–D4 on ``score_at_{m}min`` columns."""
    s = {m: F.col(f"score_at_{m}min") for m in targets}
    out: dict[str, Column] = {}
    base = s.get(5, F.lit(0.0))
    for m in targets:
        if m > 5:
            out[f"growth_rate_{m}min"] = F.coalesce((s[m] - base) / F.lit(float(m - 5)), F.lit(0.0))
    out["early_momentum"] = F.try_divide(s.get(15, F.lit(0.0)), base + F.lit(1.0))
    g30 = out.get("growth_rate_30min", F.lit(0.0))
    out["sustained_growth"] = F.coalesce(g30 > 0, F.lit(False)).cast("int")
    return out


def ladder_aliases(final_score: str = "score") -> dict[str, Column]:
    """score_{m}m aliases, velocity 5->30, score_60m falling back to score."""
    s5 = F.col("score_at_5min").cast("double")
    s30 = F.col("score_at_30min").cast("double")
    return {
        "score_5m": s5,
        "score_15m": F.col("score_at_15min").cast("double"),
        "score_30m": s30,
        "score_60m": F.coalesce(F.col("score_at_60min").cast("double"), F.col(final_score).cast("double")),
        "velocity_5_to_30m": F.coalesce((s30 - s5) / F.lit(25.0), F.lit(0.0)),
    }


def early_score_features(posts: DataFrame, snapshots: DataFrame, targets: Sequence[int] = DEFAULT_TARGETS,
                         tie_key: str = "event_id", max_gap: float | None = None) -> DataFrame:
    """D1–D5 in one plan: ladder join + one projection."""
    j = snapshot_ladder(posts, snapshots, targets, tie_key, max_gap)
    j = j.withColumns(dynamics(targets))
    if set(targets) >= {5, 15, 30, 60}:
        j = j.withColumns(ladder_aliases())
    return j


def score_deltas() -> dict[str, Column]:
    """Score deltas 5->60, 5->15, 15->30."""
    return {
        "score_delta_5_60": F.col("score_60m") - F.col("score_5m"),
        "score_delta_5_15": F.col("score_15m") - F.col("score_5m"),
        "score_delta_15_30": F.col("score_30m") - F.col("score_15m"),
    }


# ---------------------------------------------------------------------------
# Tracking state in batch form (D7–D10).  The streaming form is in
# ``riselens.streaming.ladder``.
# ---------------------------------------------------------------------------
DEFAULT_INTERVALS = (5, 15, 30, 60)
GRACE_MINUTES = 120
TOLERANCE_MINUTES = 2.0


def merge_state(state: DataFrame | None, new_posts: DataFrame, observed_ts: float,
                intervals: Sequence[int] = DEFAULT_INTERVALS, grace_minutes: float = GRACE_MINUTES) -> DataFrame:
    """Union new posts into the state; per post min created / first seen,
    max drop-after, collected flags OR-ed."""
    last = max(intervals)
    fresh = new_posts.select(
        F.col("post_id").cast("string").alias("post_id"),
        F.col("subreddit"),
        F.col("created_timestamp").cast("double").alias("created_timestamp"),
        F.lit(float(observed_ts)).alias("first_seen_timestamp"),
        F.lit(None).cast("double").alias("last_snapshot_timestamp"),
        (F.col("created_timestamp").cast("double") + F.lit(60.0 * (last + grace_minutes))).alias("drop_after_timestamp"),
        *[F.lit(False).alias(f"collected_{m}") for m in intervals],
    )
    u = fresh if state is None else state.unionByName(fresh)
    return u.groupBy("post_id").agg(
        F.first("subreddit", ignorenulls=True).alias("subreddit"),
        F.min("created_timestamp").alias("created_timestamp"),
        F.min("first_seen_timestamp").alias("first_seen_timestamp"),
        F.max("last_snapshot_timestamp").alias("last_snapshot_timestamp"),
        F.max("drop_after_timestamp").alias("drop_after_timestamp"),
        *[F.bool_or(f"collected_{m}").alias(f"collected_{m}") for m in intervals],
    )


def due(state: DataFrame, now: float, intervals: Sequence[int] = DEFAULT_INTERVALS,
        grace_minutes: float = GRACE_MINUTES, tolerance_minutes: float = TOLERANCE_MINUTES) -> DataFrame:
    """One row per (post, interval) that is due: not collected and
    m - tolerance <= age <= m + grace."""
    age = (F.lit(float(now)) - F.col("created_timestamp")) / F.lit(60.0)
    rows = state.select(
        "post_id", "subreddit", "created_timestamp", age.alias("post_age_minutes"),
        F.explode(F.array(*[F.struct(F.lit(m).alias("interval_minutes"), F.col(f"collected_{m}").alias("done"))
                            for m in intervals])).alias("iv"),
    )
    m = F.col("iv.interval_minutes")
    return rows.filter(
        ~F.col("iv.done")
        & (F.col("post_age_minutes") >= m - F.lit(tolerance_minutes))
        & (F.col("post_age_minutes") <= m + F.lit(float(grace_minutes)))
    ).select("post_id", "subreddit", "created_timestamp", "post_age_minutes", m.alias("interval_minutes"))


def mark_collected(state: DataFrame, collected: DataFrame, snapshot_ts: float,
                   intervals: Sequence[int] = DEFAULT_INTERVALS) -> DataFrame:
    """Set ``collected_m`` for (post_id, interval_minutes) rows collected."""
    flags = collected.groupBy("post_id").agg(
        *[F.bool_or(F.col("interval_minutes") == m).alias(f"hit_{m}") for m in intervals]
    )
    j = state.join(flags, "post_id", "left")
    cols = {f"collected_{m}": F.col(f"collected_{m}") | F.coalesce(F.col(f"hit_{m}"), F.lit(False)) for m in intervals}
    any_hit = F.lit(False)
    for m in intervals:
        any_hit = any_hit | F.coalesce(F.col(f"hit_{m}"), F.lit(False))
    cols["last_snapshot_timestamp"] = F.when(any_hit, F.lit(float(snapshot_ts))).otherwise(F.col("last_snapshot_timestamp"))
    return j.withColumns(cols).drop(*[f"hit_{m}" for m in intervals])


def prune(state: DataFrame, now: float, intervals: Sequence[int] = DEFAULT_INTERVALS) -> DataFrame:
    """Drop posts with every interval collected or past the horizon."""
    all_done = F.lit(True)
    for m in intervals:
        all_done = all_done & F.col(f"collected_{m}")
    expired = F.coalesce(F.lit(float(now)) >= F.col("drop_after_timestamp"), F.lit(False))
    return state.filter(~(all_done | expired))
