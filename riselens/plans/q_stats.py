"""Registered aggregation / order / sample queries with SQL oracles
(A3, A4, A9–A24, W2, W3, W5–W10)."""

from __future__ import annotations

import statistics

from pyspark.sql import functions as F

from riselens.functions.context import epoch_to_ts
from riselens.functions.titles import title_features
from riselens.operators import features as feat
from riselens.operators import stats as st
from riselens.plans import oracle_sql as O
from riselens.plans.q_core import residual_frame
from riselens.plans.registry import register, round_sql, rounded
from riselens.sources import fixtures as fx

R6 = round_sql


def stats_frame(spark, sf):
    j = residual_frame(spark, sf)
    ts = epoch_to_ts("created_timestamp")
    tf = title_features("title")
    return j.select(
        "post_id", "platform", "subreddit", "lang", "score", "comment_count", "title", "created_timestamp",
        "score_5m", "score_15m", "score_30m", "score_60m", "R",
        F.hour(ts).alias("hour_of_day"), F.weekday(ts).alias("day_of_week"), ts.alias("created_dt"),
        tf["has_question"].alias("has_question"), tf["has_exclamation"].alias("has_exclamation"),
        tf["has_numbers"].alias("has_numbers"))


_T = O.title_sql()
_SF = {
    "lad": O.ladder_sql(),
    "sfr": f"""SELECT p.post_id, p.platform, p.subreddit, p.lang, p.score, p.comment_count, p.title, p.created_timestamp,
        CAST(coalesce(l.score_at_5min, p.score) AS DOUBLE) AS score_5m, CAST(coalesce(l.score_at_15min, p.score) AS DOUBLE) AS score_15m,
        CAST(coalesce(l.score_at_30min, p.score) AS DOUBLE) AS score_30m, CAST(coalesce(l.score_at_60min, p.score) AS DOUBLE) AS score_60m,
        ln(1 + p.score) - ln(1 + greatest(coalesce(l.score_at_5min, p.score), 0)) AS R,
        hour({O.ts_from_epoch('p.created_timestamp')}) AS hour_of_day,
        isodow({O.ts_from_epoch('p.created_timestamp')}) - 1 AS day_of_week,
        {O.ts_from_epoch('p.created_timestamp')} AS created_dt,
        {_T['has_question']} AS has_question, {_T['has_exclamation']} AS has_exclamation, {_T['has_numbers']} AS has_numbers
      FROM posts p LEFT JOIN lad l USING (post_id)""",
}


def _w(body, **extra):
    return fx.sql_with(body, "posts", "snapshots", extra={**_SF, **extra})


@register("residual_table_by_hour", _w(f"""
SELECT hour_of_day, {R6('avg(R)')} AS R_mean, {R6('stddev_samp(R)')} AS R_std, count(R) AS R_count,
  {R6('avg(R) - 1.96 * stddev_samp(R) / sqrt(count(R))')} AS R_lo, {R6('avg(R) + 1.96 * stddev_samp(R) / sqrt(count(R))')} AS R_hi
FROM sfr GROUP BY hour_of_day"""))
def q_residual_table(spark, sf):
    return rounded(st.residual_table(stats_frame(spark, sf), "hour_of_day", ["R"]))


@register("min_volume_communities", _w("""
SELECT post_id, subreddit FROM sfr WHERE subreddit IN (SELECT subreddit FROM sfr GROUP BY subreddit HAVING count(*) >= 50)"""))
def q_min_volume(spark, sf):
    return st.min_volume(stats_frame(spark, sf), "subreddit", 50).select("post_id", "subreddit")


@register("value_counts_language", _w(f"""
SELECT lang, count(*) AS count, {R6('count(*) / (SELECT count(*) FROM sfr)')} AS share FROM sfr GROUP BY lang"""))
def q_value_counts(spark, sf):
    return rounded(st.value_counts(stats_frame(spark, sf), "lang"))


_PROFILE_COLS = {"score": "bigint", "comment_count": "bigint", "R": "double", "subreddit": "string", "lang": "string"}


def _profile_sql():
    parts = []
    for c, t in _PROFILE_COLS.items():
        num = f"CAST({c} AS DOUBLE)" if t != "string" else "CAST(NULL AS DOUBLE)"
        text = f"printf('%.9e', {c})" if t == "double" else f"CAST({c} AS VARCHAR)"
        quartiles = ", ".join(f"{R6(f'quantile_cont({num}, {q})')} AS p{round(q * 100)}" for q in (0.25, 0.5, 0.75))
        often = f"FROM (SELECT {c}, count(*) AS n FROM sfr WHERE {c} IS NOT NULL GROUP BY {c}) ORDER BY n DESC, {c} LIMIT 1"
        parts.append(f"""SELECT '{c}' AS "column", '{t}' AS dtype, count({c}) AS non_null, count(*) - count({c}) AS missing,
  count(DISTINCT {c}) AS "unique", {R6(f'min({num})')} AS min, {R6(f'max({num})')} AS max, {R6(f'avg({num})')} AS mean,
  {R6(f'(count(*) - count({c})) * 100.0 / count(*)')} AS missing_pct, {R6(f'stddev_samp({num})')} AS std, {quartiles},
  (SELECT {text} {often}) AS top, (SELECT n {often}) AS freq FROM sfr""")
    return " UNION ALL ".join(parts)


@register("column_profile", _w(_profile_sql()))
def q_profile(spark, sf):
    df = stats_frame(spark, sf).select(*_PROFILE_COLS)
    return rounded(st.profile(df))


@register("describe_with_percentiles", _w(" UNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) AS count, {R6(f'avg({c})')} AS mean, {R6(f'stddev_samp({c})')} AS std,
  {R6(f'min({c})')} AS min, {R6(f'quantile_cont({c}, 0.1)')} AS p10, {R6(f'quantile_cont({c}, 0.5)')} AS p50,
  {R6(f'quantile_cont({c}, 0.9)')} AS p90, {R6(f'max({c})')} AS max FROM sfr""" for c in ("R", "score_60m"))))
def q_describe(spark, sf):
    return rounded(st.describe(stats_frame(spark, sf), ["R", "score_60m"]))


@register("quality_report", _w("""
SELECT count(*) AS rows, count(*) - count(DISTINCT post_id) AS duplicate_ids,
  count(*) FILTER (WHERE abs(score - m) > 3.0 * s) AS outliers,
  count(*) FILTER (WHERE post_id IS NULL) AS null_post_id, count(*) FILTER (WHERE title IS NULL) AS null_title,
  count(*) FILTER (WHERE score IS NULL) AS null_score
FROM sfr CROSS JOIN (SELECT avg(score) AS m, stddev_samp(score) AS s FROM sfr)"""))
def q_quality(spark, sf):
    return st.quality_report(stats_frame(spark, sf).select("post_id", "title", "score"))


@register("temporal_pattern_hour_weekday", _w(f"""
SELECT 'hour' AS dimension, hour_of_day AS level, count(*) AS posts, {R6('avg(score)')} AS mean_value FROM sfr GROUP BY hour_of_day
UNION ALL SELECT 'weekday', day_of_week, count(*), {R6('avg(score)')} FROM sfr GROUP BY day_of_week"""))
def q_temporal(spark, sf):
    return rounded(st.temporal_pattern(stats_frame(spark, sf), "created_dt", "score"))


@register("title_flag_effect", _w(" UNION ALL ".join(
    f"SELECT '{f}' AS flag, {f} AS flag_value, count(*) AS posts, {R6('avg(score)')} AS mean_value FROM sfr GROUP BY {f}"
    for f in ("has_question", "has_exclamation", "has_numbers"))))
def q_flag_effect(spark, sf):
    return rounded(st.flag_effect(stats_frame(spark, sf), ["has_question", "has_exclamation", "has_numbers"]))


@register("platform_comparison", _w(f"""
SELECT platform, count(*) AS posts, {R6('avg(score)')} AS mean_score, {R6('quantile_cont(score, 0.5)')} AS median_score,
  {R6("avg(length(coalesce(title, '')))")} AS mean_title_length, {R6('avg(comment_count)')} AS mean_comments
FROM sfr GROUP BY platform"""))
def q_platforms(spark, sf):
    return rounded(st.compare_platforms(stats_frame(spark, sf)))


_EDGES = [0, 1, 5, 10, 25, 50, 100, 250, 500, 1000]


def _bucket_sql(v):
    parts = []
    for i in range(len(_EDGES) - 1):
        lo, hi = _EDGES[i], _EDGES[i + 1]
        cond = f"{v} >= {lo} AND {v} <= {hi}" if i == 0 else f"{v} > {lo} AND {v} <= {hi}"
        label = f"[{lo:g}, {hi:g}]" if i == 0 else f"({lo:g}, {hi:g}]"
        parts.append(f"WHEN {cond} THEN '{label}'")
    return f"CASE {' '.join(parts)} WHEN {v} > {_EDGES[-1]} THEN '>{_EDGES[-1]:g}' END"


@register("ladder_equality_audit", _w(f"""
SELECT {_bucket_sql('CAST(score AS DOUBLE)')} AS score_bucket, count(*) AS bucket_rows,
  {R6('avg(CAST(score_5m = score AND score_15m = score AND score_30m = score AND score_60m = score AS DOUBLE))')} AS share_all_equal,
  {R6('avg(CAST(score_5m = score AS DOUBLE))')} AS share_score_5m_equal, {R6('avg(CAST(score_15m = score AS DOUBLE))')} AS share_score_15m_equal,
  {R6('avg(CAST(score_30m = score AS DOUBLE))')} AS share_score_30m_equal, {R6('avg(CAST(score_60m = score AS DOUBLE))')} AS share_score_60m_equal
FROM sfr GROUP BY 1"""))
def q_ladder_audit(spark, sf):
    return rounded(st.ladder_audit(stats_frame(spark, sf), edges=_EDGES))


_CORR = ["R", "score_5m", "score_60m", "comment_count"]


@register("correlation_matrix", _w(" UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {R6(f'corr({a}, {b})')} AS corr FROM sfr"
    for i, a in enumerate(_CORR) for b in _CORR[i:])))
def q_corr(spark, sf):
    return rounded(st.corr_matrix(stats_frame(spark, sf), _CORR))


@register("trimmed_residual_by_community", _w(f"""
SELECT subreddit, {R6('avg(R)')} AS mean, {R6('stddev_samp(R)')} AS std, count(*) AS n FROM (
  SELECT subreddit, R, row_number() OVER (PARTITION BY subreddit ORDER BY R) AS rn, count(*) OVER (PARTITION BY subreddit) AS n
  FROM sfr WHERE R IS NOT NULL) WHERE rn > floor(n * 0.1) AND rn <= n - floor(n * 0.1) GROUP BY subreddit"""))
def q_trimmed(spark, sf):
    return rounded(st.trimmed(stats_frame(spark, sf), "subreddit", "R", 0.1))


@register("best_row_max_residual", _w(f"""
SELECT post_id, subreddit, {R6('R')} AS R FROM sfr ORDER BY R DESC, post_id DESC LIMIT 1"""))
def q_best(spark, sf):
    d = stats_frame(spark, sf).select("post_id", "subreddit", "R")
    return rounded(st.best_row(d, "R", "max", tie="post_id"))


@register("histogram_log_score", _w(f"""
SELECT least(CAST(floor((v - lo) / ((hi + 1e-12 - lo) / 20)) AS BIGINT) + 1, 20) AS bin, count(*) AS count,
  {R6('min(lo)')} AS range_lo, {R6('max(hi)')} AS range_hi
FROM (SELECT ln(1 + score) AS v FROM sfr) CROSS JOIN (SELECT min(ln(1 + score)) AS lo, max(ln(1 + score)) AS hi FROM sfr)
WHERE v IS NOT NULL GROUP BY 1"""))
def q_histogram(spark, sf):
    d = stats_frame(spark, sf).withColumn("log_score", F.log1p(F.col("score").cast("double")))
    return rounded(st.histogram(d, "log_score", 20))


_QQ_K = 19
_probs = [(i + 0.5) / _QQ_K for i in range(_QQ_K)]
_theo = [statistics.NormalDist().inv_cdf(p) for p in _probs]


@register("qq_table_residual", _w(" UNION ALL ".join(
    f"SELECT {i} AS i, {R6(repr(p))} AS prob, {R6(repr(t))} AS normal_quantile, {R6(f'quantile_cont(R, {p!r})')} AS sample_quantile FROM sfr"
    for i, (p, t) in enumerate(zip(_probs, _theo)))))
def q_qq(spark, sf):
    return rounded(st.qq_table(stats_frame(spark, sf), "R", _QQ_K))


@register("time_split_labels", _w("""
SELECT post_id, CASE WHEN created_timestamp <= (SELECT quantile_cont(created_timestamp, 0.7) FROM sfr) THEN 'train' ELSE 'test' END AS split
FROM sfr"""))
def q_time_split(spark, sf):
    return st.time_split(stats_frame(spark, sf).select("post_id", "created_timestamp"), "created_timestamp", 0.7).select(
        "post_id", "split")


@register("head_fraction_time_order", _w("""
SELECT post_id FROM (SELECT post_id, row_number() OVER (ORDER BY created_timestamp, post_id) AS rn FROM sfr)
WHERE rn <= floor((SELECT count(*) FROM sfr) * 0.3)"""))
def q_head(spark, sf):
    return st.head_fraction(stats_frame(spark, sf).select("post_id", "created_timestamp"), "created_timestamp", 0.3).select("post_id")


@register("top_residual_posts", _w(f"""
SELECT post_id, subreddit, {R6('R')} AS R FROM sfr ORDER BY R DESC NULLS LAST, post_id LIMIT 10"""))
def q_top(spark, sf):
    return rounded(st.top_k(stats_frame(spark, sf).select("post_id", "subreddit", "R"), "R", 10, False, "post_id"))


@register("bottom_residual_posts", _w(f"""
SELECT post_id, subreddit, {R6('R')} AS R FROM sfr ORDER BY R ASC NULLS LAST, post_id LIMIT 10"""))
def q_bottom(spark, sf):
    return rounded(st.top_k(stats_frame(spark, sf).select("post_id", "subreddit", "R"), "R", 10, True, "post_id"))


@register("capped_sample_per_community", _w("""
SELECT post_id, subreddit FROM (SELECT post_id, subreddit, row_number() OVER (PARTITION BY subreddit
  ORDER BY md5(post_id || '|42'), post_id) AS rn FROM sfr) WHERE rn <= 5"""))
def q_capped(spark, sf):
    return st.cap_per_group(stats_frame(spark, sf).select("post_id", "subreddit"), ["subreddit"], 5, 42)


@register("hash_ordered_sample", _w("""
SELECT post_id FROM sfr ORDER BY md5(post_id || '|42'), post_id LIMIT 50"""))
def q_sample(spark, sf):
    return st.sample_n(stats_frame(spark, sf).select("post_id"), 50, 42)


@register("group_transform_community", _w(f"""
SELECT post_id, {R6('avg(R) OVER (PARTITION BY subreddit)')} AS R_mean, {R6('stddev_samp(R) OVER (PARTITION BY subreddit)')} AS R_std,
  count(R) OVER (PARTITION BY subreddit) AS R_count FROM sfr"""))
def q_group_transform(spark, sf):
    d = feat.group_transform(stats_frame(spark, sf).select("post_id", "subreddit", "R"), "subreddit", "R", prefix="R_")
    return rounded(d.select("post_id", "R_mean", "R_std", "R_count"))


@register("fill_global_mean", _w(f"""
SELECT post_id, {R6("coalesce(CASE WHEN platform = 'reddit' THEN R END, (SELECT avg(R) FROM sfr WHERE platform = 'reddit'))")} AS R_filled
FROM sfr"""))
def q_fill(spark, sf):
    d = stats_frame(spark, sf).withColumn("R_masked", F.when(F.col("platform") == "reddit", F.col("R")))
    return rounded(st.fill_global(d, "R_masked", "mean", out="R_filled").select("post_id", "R_filled"))
