"""Normalization operators: NM1–NM15, SO1–SO3.

Each is a projection / filter / union expressed with built-in functions; the
only shuffles are the dedup aggregate (NM6, in ``features``) and the
median scalar of NM8.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riselens.functions.context import author_hash, url_domain

POST_SCHEMA = T.StructType([
    T.StructField("platform", T.StringType()),
    T.StructField("post_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("created_timestamp", T.DoubleType()),
    T.StructField("score", T.LongType()),
    T.StructField("comment_count", T.LongType()),
    T.StructField("author_hash", T.StringType()),
    T.StructField("upvote_ratio", T.DoubleType()),
    T.StructField("subreddit", T.StringType()),
    T.StructField("is_self_post", T.BooleanType()),
    T.StructField("url", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("text_content", T.StringType()),
    T.StructField("is_nsfw", T.BooleanType()),
    T.StructField("is_spoiler", T.BooleanType()),
    T.StructField("is_stickied", T.BooleanType()),
])


def _get(df: DataFrame, name: str, default, dtype: str) -> Column:
    """Column if present, else a typed literal default (schema-driven on the driver)."""
    if name in df.columns:
        return F.col(name).cast(dtype)
    return F.lit(default).cast(dtype)


def normalize_reddit(df: DataFrame) -> DataFrame:
    """NM1: raw Reddit records -> unified post schema."""
    comments = F.coalesce(F.col("num_comments").cast("long"), F.lit(0).cast("long")) if "num_comments" in df.columns else F.lit(0).cast("long")
    return df.select(
        F.lit("reddit").alias("platform"),
        F.col("id").cast("string").alias("post_id"),
        F.col("title").cast("string").alias("title"),
        F.col("created_utc").cast("double").alias("created_timestamp"),
        F.col("score").cast("long").alias("score"),
        comments.alias("comment_count"),
        author_hash("author").alias("author_hash"),
        _get(df, "upvote_ratio", None, "double").alias("upvote_ratio"),
        _get(df, "subreddit", "", "string").alias("subreddit"),
        _get(df, "is_self", False, "boolean").alias("is_self_post"),
        _get(df, "url", "", "string").alias("url"),
        _get(df, "domain", "", "string").alias("domain"),
        _get(df, "selftext", "", "string").alias("text_content"),
        _get(df, "over_18", False, "boolean").alias("is_nsfw"),
        _get(df, "spoiler", False, "boolean").alias("is_spoiler"),
        _get(df, "stickied", False, "boolean").alias("is_stickied"),
    )


def normalize_hn(df: DataFrame) -> DataFrame:
    """NM2: raw HN stories -> unified schema (self post = no URL)."""
    return df.select(
        F.lit("hackernews").alias("platform"),
        F.col("id").cast("string").alias("post_id"),
        F.col("title").cast("string").alias("title"),
        F.col("time").cast("double").alias("created_timestamp"),
        F.col("score").cast("long").alias("score"),
        F.col("descendants").cast("long").alias("comment_count"),
        author_hash("by").alias("author_hash"),
        F.lit(None).cast("double").alias("upvote_ratio"),
        F.lit("hackernews").alias("subreddit"),
        F.col("url").isNull().alias("is_self_post"),
        F.coalesce(F.col("url"), F.lit("")).alias("url"),
        url_domain("url").alias("domain"),
        _get(df, "text", "", "string").alias("text_content"),
        F.lit(False).alias("is_nsfw"),
        F.lit(False).alias("is_spoiler"),
        F.lit(False).alias("is_stickied"),
    )


def combine_platforms(*frames: DataFrame) -> DataFrame:
    """NM5 / SO1: union by name, missing columns null, sorted column order."""
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return u.select(*sorted(u.columns))


def combine_slices(frames: Sequence[DataFrame], key: str = "post_id") -> DataFrame:
    """IO12: union of slices, then one row per key (NM6)."""
    from riselens.operators.features import dedup_posts
    return dedup_posts(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames), key)


def add_quality_scores(df: DataFrame, quality: DataFrame, key: str = "post_id", value: str = "quality_score") -> DataFrame:
    """NM8: map quality scores by post id; fill with the median of the mapped
    values (one-row scalar, broadcast)."""
    q = quality.select(F.col(key).cast("string").alias(key), F.col(value).cast("double").alias(value))
    # Per-post scores are as large as the posts: a shuffle join on the key.
    j = df.withColumn(key, F.col(key).cast("string")).join(q, key, "left")
    from riselens.operators.order import exact_quantiles
    med = exact_quantiles(j, value, [0.5])[0]
    return j.withColumn(value, F.coalesce(F.col(value), F.lit(med).cast("double")))


def residual_lift(df: DataFrame, score: str = "score", quality: str = "quality_score", out: str = "residual_lift") -> DataFrame:
    """NM9: log1p(score) - log1p(quality)."""
    return df.withColumn(out, F.log1p(F.col(score).cast("double")) - F.log1p(F.col(quality).cast("double")))


def hygiene(df: DataFrame, text_cols: Sequence[str] = ("title",), cat_cols: Sequence[str] = ("subreddit", "platform")) -> DataFrame:
    """NM10: create missing string columns; null -> '' (text) / 'unknown' (category)."""
    cols = {}
    for c in text_cols:
        cols[c] = F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
    for c in cat_cols:
        cols[c] = F.coalesce(F.col(c).cast("string"), F.lit("unknown")) if c in df.columns else F.lit("unknown")
    return df.withColumns(cols)


# Priority lists for outcome / early-score discovery (NM11).
OUTCOME_CANDIDATES = ["score_60m", "score_at_60min", "score"]
EARLY_CANDIDATES = {
    "score_5m": ["score_5m", "score_at_5min"],
    "score_15m": ["score_15m", "score_at_15min"],
    "score_30m": ["score_30m", "score_at_30min"],
}


def resolve_outcome(df: DataFrame) -> DataFrame:
    """NM11: y from the first present outcome column, early scores by priority."""
    cols = df.columns

    def first(cands):
        present = [F.col(c).cast("double") for c in cands if c in cols]
        return F.coalesce(*present) if present else F.lit(None).cast("double")

    out = {"y_raw": first(OUTCOME_CANDIDATES)}
    for name, cands in EARLY_CANDIDATES.items():
        out[name] = first(cands)
    return df.withColumns(out)


def require(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NM12: ±inf/NaN -> null, then drop rows with a null in any required column."""
    fixes = {}
    for c, t in df.dtypes:
        if c in cols and t in ("double", "float"):
            v = F.col(c)
            fixes[c] = F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(v)
    return df.withColumns(fixes).na.drop(subset=list(cols))


def platform_frame(df: DataFrame, platform: str | None = "reddit", ts: str = "created_timestamp") -> DataFrame:
    """NM13: platform filter + event-time column (ordering is left to windows)."""
    out = df if platform is None else df.filter(F.col("platform") == platform)
    return out.withColumn("created_dt", F.timestamp_micros(F.round(F.col(ts).cast("double") * 1_000_000).cast("long")))


def recent(df: DataFrame, now_epoch: float, hours: float = 2.0, ts: str = "created_timestamp") -> DataFrame:
    """NM14 / IO10: posts younger than ``hours`` at ``now``."""
    return df.filter(F.col(ts).cast("double") >= F.lit(float(now_epoch) - hours * 3600.0))


def since_days(df: DataFrame, now_epoch: float, days: float, ts: str = "created_timestamp") -> DataFrame:
    """IO10: recency cutoff in days."""
    return df.filter(F.col(ts).cast("double") >= F.lit(float(now_epoch) - days * 86400.0))


def window_name(days: float) -> str:
    """IO10: days -> coarse listing window name."""
    if days <= 1:
        return "day"
    if days <= 7:
        return "week"
    if days <= 31:
        return "month"
    if days <= 365:
        return "year"
    return "all"


# Readable export (NM15).  Fixed rename map and preferred column order.
READABLE_RENAMES = {
    "post_id": "Post ID", "platform": "Platform", "subreddit": "Community", "title": "Title",
    "score": "Final Score", "comment_count": "Comments", "score_5m": "Score @5m", "score_15m": "Score @15m",
    "score_30m": "Score @30m", "score_60m": "Score @60m", "is_self_post": "Is Self Post", "is_nsfw": "Is NSFW",
}


def readable_export(df: DataFrame, limit: int | None = None, sort_desc: str | None = "score",
                    ts: str = "created_timestamp") -> DataFrame:
    """NM15: preferred columns renamed, bool -> 'yes'/'no', UTC time string,
    day label, score deltas; sorted before the optional limit (fixes the
    studied code's limit-then-sort)."""
    cols = df.columns
    raw = F.col(ts).cast("double")
    # Epoch values above 1e12 are nanoseconds (unit detection).
    secs = F.when(F.abs(raw) >= 1e12, raw / 1e9).otherwise(raw)
    t = F.timestamp_micros(F.round(secs * 1_000_000).cast("long"))
    sel = [F.date_format(t, "yyyy-MM-dd HH:mm:ss").alias("Created (UTC)"), F.date_format(t, "EEEE").alias("Day")]
    for c, label in READABLE_RENAMES.items():
        if c not in cols:
            continue
        dt = dict(df.dtypes)[c]
        v = F.col(c)
        if dt == "boolean":
            v = F.when(v, F.lit("yes")).when(~v, F.lit("no"))
        sel.append(v.alias(label))
    for a, b in (("score_5m", "score_60m"), ("score_5m", "score_15m"), ("score_15m", "score_30m")):
        if a in cols and b in cols:
            sel.append((F.col(b) - F.col(a)).alias(f"Delta {a[6:]}->{b[6:]}"))
    out = df
    if sort_desc and sort_desc in cols:
        out = out.orderBy(F.col(sort_desc).desc_nulls_last(), F.col("post_id").asc())
    out = out.select(*sel)
    return out.limit(limit) if limit else out


def due_ids(due_df: DataFrame, key: str = "post_id") -> DataFrame:
    """SO2: set union of due ids over all intervals."""
    return due_df.select(key).distinct()
