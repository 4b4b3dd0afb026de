"""Ladder ties, fallbacks, dedup, group statistics and normalisation."""

from pyspark.sql import functions as F

from riselens.operators.features import community_stats, dedup_posts
from riselens.operators.snapshots import early_score_features, ladder_scores


def test_ladder_tie_and_fallback(spark):
    posts = spark.createDataFrame([("p1", 100), ("p2", 7)], "post_id string, score long")
    snaps = spark.createDataFrame(
        [("p1", 1, 3.0, 10.0), ("p1", 2, 7.0, 20.0),      # both 2 min from 5: tie -> lower event_id
         ("p1", 3, 61.0, 99.0), ("ghost", 4, 5.0, 1.0)],  # snapshot without a post is ignored
        "post_id string, event_id long, post_age_minutes double, score double")
    out = {r["post_id"]: r for r in early_score_features(posts, snaps).collect()}
    assert out["p1"]["score_at_5min"] == 10.0
    assert out["p1"]["score_at_60min"] == 99.0
    assert out["p2"]["score_at_5min"] == 7.0 and out["p2"]["has_snapshot"] == 0   # final score fallback
    assert set(out) == {"p1", "p2"}


def test_ladder_max_gap(spark):
    snaps = spark.createDataFrame([("p", 1, 50.0, 3.0)], "post_id string, event_id long, post_age_minutes double, score double")
    r = ladder_scores(snaps, max_gap=10).collect()[0]
    assert r["score_at_5min"] is None and r["score_at_60min"] == 3.0


def test_dedup_keeps_earliest_run(spark):
    df = spark.createDataFrame([("a", 2.0, 5), ("a", 1.0, 9), ("b", 3.0, 1)],
                               "post_id string, ingested_timestamp double, score long")
    got = {r["post_id"]: r["score"] for r in dedup_posts(df).collect()}
    assert got == {"a": 9, "b": 1}


def test_single_row_community_std_is_zero(spark):
    df = spark.createDataFrame([("x", 5), ("y", 1), ("y", 3)], "subreddit string, score long")
    got = {r["subreddit"]: r for r in community_stats(df).collect()}
    assert got["x"]["subreddit_score_std"] == 0.0
    assert got["y"]["subreddit_median_score"] == 2.0


def test_dedup_written_equals_dedup_posts(spark):
    """Single ids, repeated ids, equal copies and null ids; unrepeated rows are not grouped with their texts."""
    from riselens.operators.features import dedup_written
    rows = [("a", 2, "x"), ("a", 1, "y"), ("b", 5, None), ("c", 3, "z"), ("c", 3, "z"), (None, 9, "n"), (None, 8, "m")]
    df = spark.createDataFrame(rows, "post_id string, score long, text string").repartition(3)
    for some in (df, df.where("post_id = 'b'"), df.where("score = 9")):
        key = lambda r: (str(r["post_id"]), r["score"])
        assert sorted(dedup_written(some).collect(), key=key) == sorted(dedup_posts(some).collect(), key=key)
