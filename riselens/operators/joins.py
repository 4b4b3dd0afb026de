"""Join helpers: size-checked broadcast, lookups, anti/semi joins.

Broadcast is only used behind a proof of size: either the key domain is
bounded by construction (hour of day, weekday, language) and the caller says
so, or the small side is materialised with a reliable checkpoint and its row
count checked.  Beyond the bound the join stays a shuffle join, where AQE
splits skewed partitions (one hot key may hold a third of the rows).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riselens.session import checkpoint

# Upper bound on rows of a side that may be broadcast after checking.
BROADCAST_MAX_ROWS = 2_000_000


def attach_small(
    big: DataFrame,
    small: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    bounded: bool = False,
    max_rows: int = BROADCAST_MAX_ROWS,
) -> DataFrame:
    """Join ``small`` (e.g. per-key statistics) onto ``big``.

    ``bounded=True`` declares a key domain of fixed size (hours, weekdays,
    a fixed list): broadcast without a check.  Otherwise ``small`` is
    checkpointed (computed once, lineage cut) and broadcast only when its
    row count is at most ``max_rows``; else a shuffle join is used.
    """
    if bounded:
        return big.join(F.broadcast(small), on, how)
    materialised = checkpoint(small)
    n = materialised.limit(max_rows + 1).count()
    if n <= max_rows:
        return big.join(F.broadcast(materialised), on, how)
    return big.join(materialised, on, how)


def lookup(df: DataFrame, map_df: DataFrame, key: str, value: str, default=None, out: str | None = None) -> DataFrame:
    """Map a column through a (key, value) table, with a default."""
    m = map_df.select(F.col(key), F.col(value).alias(out or value))
    res = attach_small(df, m, key, "left")
    if default is not None:
        res = res.withColumn(out or value, F.coalesce(F.col(out or value), F.lit(default)))
    return res


def attach_time(outputs: DataFrame, features: DataFrame, key: str = "post_id", ts: str = "created_timestamp") -> DataFrame:
    """Stage outputs ⋈ feature timestamps, rows without a time dropped.

    Written as left join + null drop; Catalyst rewrites it to an inner join.
    """
    t = features.select(key, ts)
    return outputs.join(t, key, "left").na.drop(subset=[ts])


def unseen(posts: DataFrame, known: DataFrame, key: str = "post_id") -> DataFrame:
    """J4 / SO3: posts whose id is not yet known (left anti join)."""
    return posts.join(known.select(key).distinct(), key, "left_anti")


def present(ids: DataFrame, details: DataFrame, key: str = "post_id") -> DataFrame:
    """Ids that have fetched details (left semi join)."""
    return ids.join(details.select(key), key, "left_semi")


def compare_coefs(a: DataFrame, b: DataFrame, key: str = "feature", left: str = "coef_raw", right: str = "coef_centered") -> DataFrame:
    """Full outer join of two coefficient tables with their difference."""
    j = a.withColumnRenamed("coef", left).join(b.withColumnRenamed("coef", right), key, "full_outer")
    return j.withColumn("coef_diff", F.col(right) - F.col(left))


def out_of_bag(df: DataFrame, weights: DataFrame, key: str = "post_id", weight: str = "w") -> DataFrame:
    """Rows absent from a resample (weight 0 or missing)."""
    drawn = weights.filter(F.col(weight) > 0).select(key)
    return df.join(drawn, key, "left_anti")
