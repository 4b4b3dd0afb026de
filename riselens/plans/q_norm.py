"""Registered queries for normalization, IO helpers, set operations and the
batch tracking-state operators (NM1–NM15, IO9, IO12, IO13, SO1–SO3, J4, J5, D7–D10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riselens.operators import normalize as nm
from riselens.operators.features import dedup_posts, flag_collection
from riselens.operators.joins import present, unseen
from riselens.operators.snapshots import due, ladder_scores, mark_collected, merge_state, prune
from riselens.plans.oracle_sql import domain_sql
from riselens.plans.registry import register, round_sql, rounded
from riselens.sources import fixtures as fx
from riselens.sources.io import collection_summary, historical

_norm_sql = fx.sql_with(f"""
SELECT author_hash, comment_count, created_timestamp, domain, is_nsfw, is_self_post, is_spoiler, is_stickied,
       platform, post_id, score, subreddit, text_content, title, upvote_ratio, url FROM (
  SELECT 'reddit' AS platform, post_id, title, created_timestamp, score, coalesce(comment_count, 0) AS comment_count,
         author_hash, upvote_ratio, subreddit, is_self_post, url, domain, text_content, is_nsfw,
         false AS is_spoiler, false AS is_stickied
  FROM posts WHERE platform = 'reddit'
  UNION ALL
  SELECT 'hackernews', post_id, title, CAST(floor(created_timestamp) AS DOUBLE), score, comment_count,
         author_hash, CAST(NULL AS DOUBLE), 'hackernews', url IS NULL, coalesce(url, ''),
         coalesce({domain_sql('url')}, ''), text_content, false, false, false
  FROM posts WHERE platform = 'hackernews')
""", "posts")


@register("normalized_posts", _norm_sql)
def q_normalized_posts(spark, sf):
    r = nm.normalize_reddit(fx.raw_reddit(spark, sf))
    h = nm.normalize_hn(fx.raw_hn(spark, sf))
    return rounded(nm.combine_platforms(r, h))


@register("collection_summary", fx.sql_with(f"""
SELECT subreddit, count(*) AS rows, count(*) FILTER (WHERE collection_type = 'top') AS top_rows,
       count(*) FILTER (WHERE collection_type = 'new') AS new_rows, CAST(min(score) AS DOUBLE) AS min_score,
       CAST(max(score) AS DOUBLE) AS max_score, {round_sql('avg(score)')} AS avg_score
FROM posts GROUP BY subreddit""", "posts"))
def q_collection_summary(spark, sf):
    return rounded(collection_summary(fx.posts(spark, sf)))


@register("dedup_slices_collection_flag", fx.sql_with("""
SELECT post_id, score, CAST(1.0 AS DOUBLE) AS ingested_timestamp, CAST(coalesce(collection_type = 'new', false) AS INTEGER) AS is_new_collection
FROM posts""", "posts"))
def q_dedup(spark, sf):
    p = fx.posts(spark, sf).select("post_id", "score", "collection_type")
    first = p.withColumn("ingested_timestamp", F.lit(1.0))
    later = p.withColumns({"ingested_timestamp": F.lit(2.0), "score": F.col("score") + 1,
                           "collection_type": F.lit("new")})
    d = nm.combine_slices([later, first])
    return rounded(flag_collection(d).select("post_id", "score", "ingested_timestamp", "is_new_collection"))


@register("quality_fill_residual_lift", fx.sql_with(f"""
SELECT post_id, {round_sql('q')} AS quality_score, {round_sql('ln(1 + score) - ln(1 + q)')} AS residual_lift
FROM (SELECT p.post_id, p.score, coalesce(l.q, (SELECT quantile_cont(l2.q, 0.5) FROM posts p2
                LEFT JOIN qs l2 ON l2.post_id = p2.post_id)) AS q
      FROM posts p LEFT JOIN qs l ON l.post_id = p.post_id)
""", "posts", "snapshots", extra={"qs": """SELECT s.post_id, first(s.score ORDER BY abs(s.post_age_minutes - 5.0), s.event_id) AS q
  FROM snapshots s JOIN posts p ON p.post_id = s.post_id WHERE p.platform = 'reddit' GROUP BY s.post_id"""}))
def q_quality(spark, sf):
    p = fx.posts(spark, sf)
    reddit_ids = p.filter(F.col("platform") == "reddit").select("post_id")
    snaps = fx.snapshots(spark, sf).join(reddit_ids, "post_id", "left_semi")
    q = ladder_scores(snaps, targets=(5,)).select("post_id", F.col("score_at_5min").alias("quality_score"))
    out = nm.residual_lift(nm.add_quality_scores(p.select("post_id", "score"), q))
    return rounded(out.select("post_id", "quality_score", "residual_lift"))


@register("hygiene_outcome_require", fx.sql_with("""
SELECT post_id, coalesce(title, '') AS title, coalesce(subreddit, 'unknown') AS subreddit,
       CAST(score AS DOUBLE) AS y_raw
FROM posts WHERE upvote_ratio IS NOT NULL AND NOT isnan(upvote_ratio)""", "posts"))
def q_hygiene(spark, sf):
    p = fx.posts(spark, sf).select("post_id", "title", "subreddit", "platform", "score", "upvote_ratio")
    h = nm.require(nm.resolve_outcome(nm.hygiene(p)), ["upvote_ratio"])
    return rounded(h.select("post_id", "title", "subreddit", "y_raw"))


READABLE_LIMIT = 100


@register("readable_export", fx.sql_with(f"""
SELECT strftime(make_timestamp(CAST(round(created_timestamp * 1000000) AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS "Created (UTC)",
       strftime(make_timestamp(CAST(round(created_timestamp * 1000000) AS BIGINT)), '%A') AS "Day",
       post_id AS "Post ID", platform AS "Platform", subreddit AS "Community", title AS "Title",
       score AS "Final Score", comment_count AS "Comments",
       CASE WHEN is_self_post THEN 'yes' ELSE 'no' END AS "Is Self Post",
       CASE WHEN is_nsfw THEN 'yes' ELSE 'no' END AS "Is NSFW"
FROM posts ORDER BY score DESC, post_id LIMIT {READABLE_LIMIT}""", "posts"))
def q_readable(spark, sf):
    return nm.readable_export(fx.posts(spark, sf), limit=READABLE_LIMIT)


# Tracking-state cycle at a fixed clock inside the test month.
STATE_NOW = 1705276800.0  # 2024-01-15 00:00 UTC
_state_cte = {"st": f"""SELECT post_id, subreddit, created_timestamp,
    ({STATE_NOW} - created_timestamp) / 60.0 AS age FROM posts"""}


@register("tracking_due_snapshots", fx.sql_with(f"""
SELECT post_id, subreddit, created_timestamp, {round_sql('age')} AS post_age_minutes, iv AS interval_minutes
FROM st, (VALUES (5), (15), (30), (60)) v(iv)
WHERE age >= iv - 2.0 AND age <= iv + 120.0""", "posts", extra=_state_cte))
def q_due(spark, sf):
    state = merge_state(None, fx.posts(spark, sf), observed_ts=STATE_NOW)
    return rounded(due(state, STATE_NOW))


@register("tracking_state_after_cycle", fx.sql_with("""
SELECT post_id, coalesce(bool_or(iv = 5), false) AS collected_5, coalesce(bool_or(iv = 15), false) AS collected_15,
       coalesce(bool_or(iv = 30), false) AS collected_30, coalesce(bool_or(iv = 60), false) AS collected_60
FROM (SELECT st.post_id, v.iv FROM st LEFT JOIN (VALUES (5), (15), (30), (60)) v(iv)
        ON st.age >= v.iv - 2.0 AND st.age <= v.iv + 120.0
      WHERE st.created_timestamp + 60.0 * 180 > {now})
GROUP BY post_id
HAVING NOT (coalesce(bool_or(iv = 5), false) AND coalesce(bool_or(iv = 15), false)
            AND coalesce(bool_or(iv = 30), false) AND coalesce(bool_or(iv = 60), false))
""".replace("{now}", repr(STATE_NOW)), "posts", extra=_state_cte))
def q_state_cycle(spark, sf):
    state = merge_state(None, fx.posts(spark, sf), observed_ts=STATE_NOW)
    d = due(state, STATE_NOW)
    marked = mark_collected(state, d, STATE_NOW)
    kept = prune(marked, STATE_NOW)
    return kept.select("post_id", "collected_5", "collected_15", "collected_30", "collected_60")


@register("unseen_posts_anti_join", fx.sql_with("""
SELECT post_id FROM posts WHERE post_id NOT IN (SELECT post_id FROM posts WHERE collection_type = 'top')""", "posts"))
def q_unseen(spark, sf):
    p = fx.posts(spark, sf)
    known = p.filter(F.col("collection_type") == "top")
    return unseen(p.select("post_id"), known)


@register("present_ids_semi_join", fx.sql_with("""
SELECT DISTINCT p.post_id FROM posts p WHERE p.comment_count > 50
  AND EXISTS (SELECT 1 FROM snapshots s WHERE s.post_id = p.post_id AND s.num_comments > 90)""", "posts", "snapshots"))
def q_present(spark, sf):
    ids = fx.posts(spark, sf).filter(F.col("comment_count") > 50).select("post_id")
    details = fx.snapshots(spark, sf).filter(F.col("num_comments") > 90)
    return present(ids, details).distinct()


HIST_START, HIST_END, HIST_MAX = 1704067200.0, 1705276800.0, 1000


@register("historical_stories", fx.sql_with(f"""
SELECT CAST(post_id AS BIGINT) AS id, title, CAST(floor(created_timestamp) AS BIGINT) AS time, score
FROM posts WHERE platform = 'hackernews'
  AND CAST(floor(created_timestamp) AS BIGINT) BETWEEN {HIST_START} AND {HIST_END}
ORDER BY time DESC, id DESC LIMIT {HIST_MAX}""", "posts"))
def q_historical(spark, sf):
    h = fx.raw_hn(spark, sf)
    return historical(h, HIST_START, HIST_END, HIST_MAX).select("id", "title", "time", "score")


@register("recency_filters", fx.sql_with(f"""
SELECT post_id, created_timestamp >= {STATE_NOW} - 2 * 3600.0 AS within_2h FROM posts
WHERE created_timestamp >= {STATE_NOW} - 7 * 86400.0""", "posts"))
def q_recency(spark, sf):
    """IO10 (days cutoff) and NM14 (two-hour recency flag) at a fixed clock."""
    p = fx.posts(spark, sf).select("post_id", "created_timestamp")
    week = nm.since_days(p, STATE_NOW, 7)
    recent_ids = nm.recent(week, STATE_NOW, 2.0).select("post_id").withColumn("within_2h", F.lit(True))
    return week.join(recent_ids, "post_id", "left").select(
        "post_id", F.coalesce(F.col("within_2h"), F.lit(False)).alias("within_2h"))


@register("append_unseen_slice", fx.sql_with(f"""
SELECT post_id, 'run-0001' AS collection_run_id, CAST({STATE_NOW} AS DOUBLE) AS ingested_timestamp
FROM posts WHERE coalesce(collection_type, '') <> 'top'""", "posts"))
def q_append_slice(spark, sf):
    """IO11: unseen posts stamped with the run id and appended, partitioned by run."""
    import uuid
    from riselens.session import ensure_checkpoint_dir
    from riselens.sources.io import append_slice
    p = fx.posts(spark, sf).select("post_id", "collection_type")
    known = p.filter(F.col("collection_type") == "top")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/slices/{uuid.uuid4().hex}"
    append_slice(p, known, "run-0001", STATE_NOW, path)
    return spark.read.parquet(path).select("post_id", "collection_run_id", "ingested_timestamp")
