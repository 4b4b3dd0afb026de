"""Per-post feature operators: dedup (NM6), collection flag (NM7), group
statistics (A1, A2, A3, C9, C10), title and context feature blocks.

Group statistics are ``groupBy`` aggregates (partial aggregation before the
shuffle, so a hot community or the shared 'anonymous' author never moves as a
group) attached back with ``attach_small`` (checked broadcast, else a shuffle
join with AQE skew splitting).  Window partitions over a community are avoided
on purpose: they would route a whole community through one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riselens.functions import context as ctx
from riselens.functions.titles import title_features
from riselens.operators.joins import BROADCAST_MAX_ROWS, attach_small
from riselens.session import checkpoint


def dedup_posts(df: DataFrame, key: str = "post_id", order: Sequence[str] | None = None) -> DataFrame:
    """NM6: one row per key, the first by an explicit total order.

    ``min_by(struct(all columns), order)`` is a partial aggregate: duplicates
    are collapsed map-side, so even a key holding a third of the rows is
    reduced before the shuffle.  Default order: ingestion time, then all
    columns (a total order, so the result is deterministic).
    """
    cols = df.columns
    if order is None:
        order = [c for c in ("ingested_timestamp", "collection_run_id") if c in cols]
    ordering = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in cols if c not in order]) if order else F.struct(*[F.col(c) for c in cols])
    row = F.struct(*[F.col(c) for c in cols if c != key])
    first = df.groupBy(key).agg(F.min_by(row, ordering).alias("_r"))
    return first.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols if c != key]).select(*cols)


def dedup_written(df: DataFrame, key: str = "post_id") -> DataFrame:
    """``dedup_posts`` of a written table: only the rows of keys that occur more than once are shuffled and compared.

    The keys are counted first (a scan of one column); with more repeated keys
    than may be broadcast, all rows take the general way.
    """
    counts = df.groupBy(F.col(key).alias("_repeated")).agg(F.count(F.lit(1)).alias("_n"))
    repeated = checkpoint(counts.where("_n > 1").select("_repeated"))
    if repeated.limit(BROADCAST_MAX_ROWS + 1).count() > BROADCAST_MAX_ROWS:
        return dedup_posts(df, key)
    same = F.col(key).eqNullSafe(F.col("_repeated"))
    once, often = (df.join(F.broadcast(repeated), same, how) for how in ("left_anti", "left_semi"))
    return once.unionByName(dedup_posts(often, key))


def flag_collection(df: DataFrame) -> DataFrame:
    """NM7: collection_type defaults to 'top' when absent; is_new_collection."""
    if "collection_type" not in df.columns:
        df = df.withColumn("collection_type", F.lit("top"))
    return df.withColumn("is_new_collection", F.coalesce(F.col("collection_type") == "new", F.lit(False)).cast("int"))


def community_stats(df: DataFrame, key: str = "subreddit", value: str = "score", exact_median: bool = True) -> DataFrame:
    """A1 (+ C10): mean / median / count / std (ddof 1, single row -> 0)."""
    v = F.col(value).cast("double")
    src = df.filter(F.col(key).isNotNull())
    moments = src.groupBy(key).agg(
        F.avg(v).alias(f"{key}_avg_score"),
        F.count(F.lit(1)).alias(f"{key}_post_count_global"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"{key}_score_std"),
        *([] if exact_median else [F.percentile_approx(v, 0.5, 10000).cast("double").alias(f"{key}_median_score")]),
    )
    if not exact_median:
        return moments
    # Exact median by selection (no per-group value buffer, no sort).
    from riselens.operators.order import group_quantiles
    med = group_quantiles(src, [key], value, [0.5]).withColumnRenamed("q0", f"{key}_median_score")
    return moments.join(med, key, "left").select(
        key, f"{key}_avg_score", f"{key}_median_score", f"{key}_post_count_global", f"{key}_score_std")


def author_stats(df: DataFrame, key: str = "author_hash", value: str = "score") -> DataFrame:
    """A2: author mean / count of score."""
    v = F.col(value).cast("double")
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.avg(v).alias("author_avg_score"),
        F.count(F.lit(1)).alias("author_post_count_global"),
    )


def with_group_stats(df: DataFrame, community: str = "subreddit", author: str = "author_hash",
                     value: str = "score", exact_median: bool = True) -> DataFrame:
    """Attach A1 and A2 to every post (fills as in the studied code)."""
    out = df
    if community in df.columns:
        out = attach_small(out, community_stats(df, community, value, exact_median), community)
        out = out.withColumn(f"{community}_score_std", F.coalesce(F.col(f"{community}_score_std"), F.lit(0.0)))
    if author in df.columns:
        out = attach_small(out, author_stats(df, author, value), author)
        out = out.withColumns({
            "author_avg_score": F.coalesce(F.col("author_avg_score"), F.lit(0.0)),
            "author_post_count_global": F.coalesce(F.col("author_post_count_global"), F.lit(0)),
        })
    return out


def group_transform(df: DataFrame, key: str | Sequence[str], value: str,
                    aggs: Sequence[str] = ("mean", "std", "count"), prefix: str | None = None) -> DataFrame:
    """Group aggregates broadcast back to rows (pandas ``transform``).

    Expressed as aggregate + join rather than an unbounded window, so that a
    hot group is partially aggregated instead of sorted in one task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    v = F.col(value).cast("double")
    pre = prefix or f"{value}_"
    fn = {"mean": F.avg(v), "std": F.stddev_samp(v), "count": F.count(v), "sum": F.sum(v),
          "min": F.min(v), "max": F.max(v)}
    stats = df.groupBy(*keys).agg(*[fn[a].alias(pre + a) for a in aggs])
    return attach_small(df, stats, keys)


def context_features(df: DataFrame, as_of_epoch: float, community: str = "subreddit",
                     ts_candidates: Sequence[str] = ("created_timestamp", "created_utc", "time")) -> DataFrame:
    """C1–C10 in one projection plus two count aggregates.

    ``as_of_epoch`` replaces the wall clock of the studied code (C4).
    """
    cols = df.columns
    ts_col = next((c for c in ts_candidates if c in cols), None)
    if ts_col is None:
        raise ValueError("need one of created_timestamp, created_utc, time")
    ts = ctx.epoch_to_ts(ts_col)
    feats: dict[str, Column] = {}
    feats.update(ctx.hour_flags(ts))
    feats.update(ctx.weekday_flags(ts))
    feats.update(ctx.age_features(ts_col, as_of_epoch))
    self_col = "is_self_post" if "is_self_post" in cols else ("is_self" if "is_self" in cols else None)
    if "url" in cols:
        feats.update(ctx.url_flags("url", self_col))
    out = df.withColumns(feats)

    author_col = next((c for c in ("author", "by", "author_hash") if c in cols), None)
    if author_col is not None:
        counts = df.filter(F.col(author_col).isNotNull()).groupBy(author_col).agg(
            F.count(F.lit(1)).alias("author_post_count"))
        out = attach_small(out, counts, author_col)
        apc = F.coalesce(F.col("author_post_count"), F.lit(1)).cast("double")
        out = out.withColumns({
            "has_author": F.col(author_col).isNotNull().cast("int"),
            "author_post_count": apc,
            "is_frequent_poster": (apc >= 5).cast("int"),
            "author_post_count_log": F.log1p(apc),
        })
    if community in cols:
        if f"{community}_post_count_global" in out.columns:
            out = out.withColumn(f"{community}_post_count",
                                 F.coalesce(F.col(f"{community}_post_count_global"), F.lit(0)).cast("double"))
        else:
            counts = df.filter(F.col(community).isNotNull()).groupBy(community).agg(
                F.count(F.lit(1)).cast("double").alias(f"{community}_post_count"))
            out = attach_small(out, counts, community)
            out = out.withColumn(f"{community}_post_count", F.coalesce(F.col(f"{community}_post_count"), F.lit(0.0)))
    return out


def with_title_features(df: DataFrame, title: str = "title") -> DataFrame:
    """T1–T20 as one projection over a token array computed once per row.

    The token array is its own projection below the features; Catalyst keeps
    it separate (it is referenced many times and is not cheap), so every
    title is split once.
    """
    from riselens.functions.titles import clean_title, tokens
    with_toks = df.withColumn("_title_tokens", tokens(clean_title(title)))
    return with_toks.withColumns(title_features(title, "_title_tokens")).drop("_title_tokens")
