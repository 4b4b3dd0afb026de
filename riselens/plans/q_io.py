"""Registered scan queries (IO1, IO2, IO4, IO5): the posts and snapshots of
the test tables are written as a collection folder (platform files, a feature
file and nested snapshot files) and scanned back with path selection."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riselens.plans.registry import register, round_sql, rounded
from riselens.session import ensure_checkpoint_dir
from riselens.sources import fixtures as fx
from riselens.sources import io as IO

_DIRS: dict = {}


def collection_folder(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _DIRS:
        root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/collections/{uuid.uuid4().hex}"
        p = fx.posts(spark, sf).drop("lang")
        IO.write_posts(p.filter(F.col("platform") == "reddit"), f"{root}/reddit_posts.parquet", ["date"])
        IO.write_posts(p.filter(F.col("platform") == "hackernews"), f"{root}/hackernews_posts.parquet")
        p.select("post_id", F.lit(1.0).alias("junk")).write.parquet(f"{root}/features.parquet")
        s = fx.snapshots(spark, sf)
        s.filter(F.col("post_id").cast("long") % 2 == 0).write.parquet(f"{root}/runs/a/reddit_snapshots.parquet")
        s.filter(F.col("post_id").cast("long") % 2 == 1).withColumnRenamed("post_id", "story_id").withColumnRenamed(
            "post_age_minutes", "story_age_minutes").write.parquet(f"{root}/runs/b/hn_snapshots.parquet")
        _DIRS[key] = root
    return _DIRS[key]


@register("scan_posts_reddit", fx.sql_with("SELECT post_id, subreddit, score FROM posts WHERE platform = 'reddit'", "posts"))
def q_scan_reddit(spark, sf):
    return IO.scan_posts(spark, collection_folder(spark, sf), "reddit").select("post_id", "subreddit", "score")


@register("scan_posts_both", fx.sql_with("SELECT post_id, platform, score FROM posts", "posts"))
def q_scan_both(spark, sf):
    return IO.scan_posts(spark, collection_folder(spark, sf), "both").select("post_id", "platform", "score")


@register("scan_snapshots_recursive", fx.sql_with(
    f"SELECT post_id, event_id, {round_sql('post_age_minutes')} AS post_age_minutes, {round_sql('score')} AS score FROM snapshots",
    "snapshots"))
def q_scan_snapshots(spark, sf):
    s = IO.scan_snapshots(spark, collection_folder(spark, sf))
    return rounded(s.select("post_id", "event_id", "post_age_minutes", "score"))


@register("raw_json_landing_parse", fx.sql_with("""
SELECT CAST(post_id AS BIGINT) AS id, title, substr(text_content, 1, 500) AS text, score, author AS by,
       CAST(floor(created_timestamp) AS BIGINT) AS time, comment_count AS descendants, CAST(0 AS BIGINT) AS kids
FROM posts WHERE platform = 'hackernews'""", "posts"))
def q_raw_json(spark, sf):
    """IO8: raw HN records landed as JSON lines (plus non-story items) are
    parsed with an explicit schema, cut to 500 characters and filtered to stories."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/landing/{uuid.uuid4().hex}"
    raw = fx.raw_hn(spark, sf).withColumn("type", F.lit("story")).withColumn("kids", F.array().cast("array<bigint>"))
    comments = raw.orderBy("id").limit(5).withColumn("type", F.lit("comment"))
    raw.unionByName(comments).select(F.to_json(F.struct(*raw.columns)).alias("value")).write.text(root)
    parsed = IO.parse_raw_posts(spark.read.text(root), "hackernews")
    return parsed.select("id", "title", "text", "score", "by", "time", "descendants", "kids")


@register("raw_reddit_landing_parse", fx.sql_with(f"""
SELECT post_id AS id, subreddit, title, substr(text_content, 1, 500) AS selftext, author, is_self_post AS is_self, url, domain,
       score, comment_count AS num_comments, {round_sql('created_timestamp')} AS created_utc
FROM posts WHERE platform = 'reddit'""", "posts"))
def q_raw_reddit(spark, sf):
    """IO8: the other platform's records, landed as JSON lines with whole texts, parsed and cut to 500 characters."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/landing/{uuid.uuid4().hex}"
    raw = fx.raw_reddit(spark, sf)
    raw.select(F.to_json(F.struct(*raw.columns)).alias("value")).write.text(root)
    parsed = IO.parse_raw_posts(spark.read.text(root), "reddit")
    return rounded(parsed.select("id", "subreddit", "title", "selftext", "author", "is_self", "url", "domain", "score", "num_comments", "created_utc"))


@register("report_sinks_roundtrip", fx.sql_with(f"""
SELECT subreddit, count(*) AS rows, {round_sql('avg(score)')} AS avg_score FROM posts GROUP BY subreddit""", "posts"))
def q_report_roundtrip(spark, sf):
    """IO6 / IO7 / IO3: a summary written as CSV and as a JSON report, then
    loaded back (parquet-or-csv resolution)."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/reports/{uuid.uuid4().hex}"
    summ = fx.posts(spark, sf).groupBy("subreddit").agg(F.count(F.lit(1)).alias("rows"), F.avg("score").alias("avg_score"))
    IO.write_csv(summ, f"{root}/summary.csv")
    IO.write_report(summ.agg(F.collect_list(F.struct("subreddit", "rows")).alias("communities")), f"{root}/report.json")
    back = IO.load_table(spark, f"{root}/summary")
    return rounded(back.select("subreddit", F.col("rows").cast("long").alias("rows"), F.col("avg_score").cast("double")))
