"""Core registered queries: title / context features, snapshot ladder,
community lift (the first end-to-end slice)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riselens.operators import features as feat
from riselens.operators.snapshots import early_score_features
from riselens.operators.stats import community_lift
from riselens.plans import oracle_sql as O
from riselens.plans.registry import register, rounded, round_sql
from riselens.sources import fixtures as fx

# Fixed evaluation time for age features of the test data (2024-02-01 UTC).
AS_OF = 1706745600.0
TITLE_COLS = list(O.title_sql().keys())
CONTEXT_COLS = list(O.context_sql().keys())


def residual_frame(spark, sf):
    """Posts with the ladder and the residual lift R = log1p(score) - log1p(score_5m)."""
    p = fx.posts(spark, sf)
    s = fx.snapshots(spark, sf)
    j = early_score_features(p, s)
    return j.withColumn("R", F.log1p(F.col("score").cast("double")) - F.log1p(F.greatest(F.col("score_5m"), F.lit(0.0))))


# -- T1–T20 -----------------------------------------------------------------
_title_sel = ",\n  ".join(
    (round_sql(v) if k in ("title_chars_per_word", "capitalization_ratio", "flesch_kincaid_grade",
                            "avg_word_length", "type_token_ratio") else v) + f" AS {k}"
    for k, v in O.title_sql().items())


@register("title_features", fx.sql_with(f"SELECT post_id,\n  {_title_sel}\nFROM posts", "posts"))
def q_title_features(spark, sf):
    p = fx.posts(spark, sf)
    return rounded(feat.with_title_features(p).select("post_id", *TITLE_COLS))


# -- C1–C8 ------------------------------------------------------------------
_ctx = O.context_sql(ts=O.ts_from_epoch(), as_of=AS_OF)
_ctx_sel = ",\n  ".join(
    (round_sql(v) if k in ("hour_sin", "hour_cos", "age_hours", "log_age_hours") else v) + f" AS {k}" for k, v in _ctx.items())


@register("context_time_url_features", fx.sql_with(f"SELECT post_id,\n  {_ctx_sel}\nFROM posts", "posts"))
def q_context_features(spark, sf):
    p = fx.posts(spark, sf).select("post_id", "created_timestamp", "url", "is_self_post")
    out = feat.context_features(p, AS_OF)
    return rounded(out.select("post_id", *CONTEXT_COLS))


# -- C9, C10, A1, A2 ---------------------------------------------------------
@register("group_statistics", fx.sql_with(f"""
SELECT p.post_id,
  {round_sql('c.avg_s')} AS subreddit_avg_score, {round_sql('c.med_s')} AS subreddit_median_score,
  c.n AS subreddit_post_count_global, {round_sql('coalesce(c.std_s, 0.0)')} AS subreddit_score_std,
  {round_sql('a.avg_a')} AS author_avg_score, a.n_a AS author_post_count_global,
  CAST(ac.n_raw AS DOUBLE) AS author_post_count, CAST(ac.n_raw >= 5 AS INTEGER) AS is_frequent_poster,
  {round_sql('ln(1 + ac.n_raw)')} AS author_post_count_log, CAST(c.n AS DOUBLE) AS subreddit_post_count
FROM posts p
JOIN (SELECT subreddit, avg(score) AS avg_s, quantile_cont(score, 0.5) AS med_s, count(*) AS n,
             stddev_samp(score) AS std_s FROM posts GROUP BY subreddit) c USING (subreddit)
JOIN (SELECT author_hash, avg(score) AS avg_a, count(*) AS n_a FROM posts GROUP BY author_hash) a USING (author_hash)
JOIN (SELECT author, count(*) AS n_raw FROM posts GROUP BY author) ac USING (author)
""", "posts"))
def q_group_statistics(spark, sf):
    p = fx.posts(spark, sf).select("post_id", "subreddit", "author", "author_hash", "score", "created_timestamp")
    g = feat.with_group_stats(p)
    c = feat.context_features(g, AS_OF)
    return rounded(c.select(
        "post_id", "subreddit_avg_score", "subreddit_median_score", "subreddit_post_count_global",
        "subreddit_score_std", "author_avg_score", "author_post_count_global", "author_post_count",
        "is_frequent_poster", "author_post_count_log", "subreddit_post_count"))


# -- J2, D1–D5 ---------------------------------------------------------------
LADDER_COLS = ["score_at_5min", "score_at_15min", "score_at_30min", "score_at_60min", "has_snapshot",
               "growth_rate_15min", "growth_rate_30min", "growth_rate_60min", "early_momentum",
               "sustained_growth", "velocity_5_to_30m", "score_60m"]


@register("snapshot_ladder", fx.sql_with(f"""
SELECT post_id,
  coalesce(l.score_at_5min, p.score) AS score_at_5min, coalesce(l.score_at_15min, p.score) AS score_at_15min,
  coalesce(l.score_at_30min, p.score) AS score_at_30min, coalesce(l.score_at_60min, p.score) AS score_at_60min,
  CAST(l.n_snapshots IS NOT NULL AS INTEGER) AS has_snapshot,
  {round_sql('(coalesce(l.score_at_15min, p.score) - coalesce(l.score_at_5min, p.score)) / 10.0')} AS growth_rate_15min,
  {round_sql('(coalesce(l.score_at_30min, p.score) - coalesce(l.score_at_5min, p.score)) / 25.0')} AS growth_rate_30min,
  {round_sql('(coalesce(l.score_at_60min, p.score) - coalesce(l.score_at_5min, p.score)) / 55.0')} AS growth_rate_60min,
  {round_sql('coalesce(l.score_at_15min, p.score) / NULLIF(coalesce(l.score_at_5min, p.score) + 1.0, 0)')} AS early_momentum,
  CAST((coalesce(l.score_at_30min, p.score) - coalesce(l.score_at_5min, p.score)) / 25.0 > 0 AS INTEGER) AS sustained_growth,
  {round_sql('(coalesce(l.score_at_30min, p.score) - coalesce(l.score_at_5min, p.score)) / 25.0')} AS velocity_5_to_30m,
  CAST(coalesce(l.score_at_60min, p.score) AS DOUBLE) AS score_60m
FROM posts p LEFT JOIN lad l USING (post_id)
""", "posts", "snapshots", extra={"lad": O.ladder_sql()}))
def q_snapshot_ladder(spark, sf):
    j = early_score_features(fx.posts(spark, sf), fx.snapshots(spark, sf))
    return rounded(j.select("post_id", *LADDER_COLS))


# -- A8 (P0 slice) -------------------------------------------------------------
COMMUNITY_MIN_POSTS = 20

_lift_sql = fx.sql_with(f"""
SELECT subreddit, count(R) AS posts, {round_sql('avg(R)')} AS mean_residual,
  {round_sql('quantile_cont(R, 0.5)')} AS median_residual, {round_sql('stddev_samp(R)')} AS std_residual,
  {round_sql('avg(CAST(R > 0 AS DOUBLE))')} AS positive_share, {round_sql('avg(abs(R))')} AS mean_abs_residual,
  {round_sql('quantile_cont(R, 0.9)')} AS residual_90p, {round_sql('quantile_cont(R, 0.1)')} AS residual_10p,
  {round_sql('quantile_cont(R, 0.9) - quantile_cont(R, 0.1)')} AS residual_iqr,
  {round_sql('avg(CAST(R > 0 AS DOUBLE)) - 0.5')} AS lift_margin
FROM (SELECT p.subreddit, ln(1 + p.score) - ln(1 + greatest(coalesce(l.score_at_5min, p.score), 0)) AS R
      FROM posts p LEFT JOIN lad l USING (post_id))
GROUP BY subreddit HAVING count(R) >= {COMMUNITY_MIN_POSTS}
""", "posts", "snapshots", extra={"lad": O.ladder_sql()})


@register("community_lift", _lift_sql)
def q_community_lift(spark, sf):
    return rounded(community_lift(residual_frame(spark, sf), "subreddit", "R", min_posts=COMMUNITY_MIN_POSTS))


# -- C11, C12 ----------------------------------------------------------------
@register("notebook_flags_and_interactions", fx.sql_with(f"""
SELECT post_id,
  CAST(starts_with(lower(coalesce(domain, '')), 'self.') AS INTEGER) AS is_self,
  CAST(lower(coalesce(domain, '')) IN ('i.redd.it', 'imgur.com', 'i.imgur.com') AS INTEGER) AS is_image,
  CAST(h IN (0, 1, 2, 3, 4, 5, 22, 23) AS DOUBLE) AS is_off_peak, CAST(d >= 5 AS DOUBLE) AS is_weekend_flag,
  CAST(has_numbers AS DOUBLE) * CAST(h IN (0, 1, 2, 3, 4, 5, 22, 23) AS DOUBLE) AS has_numbers_offpeak,
  CAST(clickbait_patterns AS DOUBLE) * CAST(h IN (0, 1, 2, 3, 4, 5, 22, 23) AS DOUBLE) AS clickbait_patterns_offpeak,
  CAST(has_question AS DOUBLE) * CAST(d >= 5 AS DOUBLE) AS has_question_weekend
FROM (SELECT post_id, domain, hour({O.ts_from_epoch()}) AS h, isodow({O.ts_from_epoch()}) - 1 AS d,
        {O.title_sql()['has_numbers']} AS has_numbers, {O.title_sql()['clickbait_patterns']} AS clickbait_patterns,
        {O.title_sql()['has_question']} AS has_question FROM posts)""", "posts"))
def q_flags_interactions(spark, sf):
    from riselens.functions import context as ctx
    from riselens.functions.titles import title_features
    p = fx.posts(spark, sf)
    ts = ctx.epoch_to_ts("created_timestamp")
    tf = title_features("title")
    base = p.select("post_id", "domain", F.hour(ts).alias("hour_of_day"), F.weekday(ts).alias("day_of_week"),
                    tf["has_numbers"].alias("has_numbers"), tf["clickbait_patterns"].alias("clickbait_patterns"),
                    tf["has_question"].alias("has_question"))
    no_sentiment = {c: F.lit(0.0) for c in ("sentiment_compound", "sentiment_negative", "sentiment_positive")}
    feats = {**ctx.notebook_content_flags("domain"),
             **ctx.interaction_features("hour_of_day", "day_of_week", no_sentiment)}
    out = base.withColumns(feats)
    return rounded(out.select("post_id", "is_self", "is_image", "is_off_peak", "is_weekend_flag",
                              "has_numbers_offpeak", "clickbait_patterns_offpeak", "has_question_weekend"))
