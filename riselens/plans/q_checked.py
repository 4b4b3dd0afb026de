"""Model-half operators on frames without fitted trees or tokens, each against SQL
(A5–A7, J8, M1–M4, M6, M21, W4, W11, E10, E15, E19)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riselens.functions.context import epoch_to_ts
from riselens.operators import evaluate as ev
from riselens.operators import factors as X
from riselens.operators import gram as G
from riselens.operators import stats as st
from riselens.operators.joins import compare_coefs
from riselens.operators.snapshots import early_score_features
from riselens.plans import diagnostics as D
from riselens.plans import stage as S
from riselens.plans.q_eval import MODELS, _with, baseline_frame
from riselens.plans.q_stats import _w, stats_frame
from riselens.plans.registry import register, round_sql, rounded
from riselens.sources import fixtures as fx

R = round_sql


@register("calibration_by_hour_and_community", _w(f"""
SELECT 'hour_of_day' AS dimension, CAST(hour_of_day AS VARCHAR) AS level, {R('avg(R)')} AS mean_residual, count(R) AS n
FROM sfr WHERE hour_of_day IS NOT NULL GROUP BY hour_of_day HAVING count(R) > 0
UNION ALL SELECT 'subreddit', subreddit, {R('avg(R)')}, count(R) FROM sfr WHERE subreddit IS NOT NULL GROUP BY subreddit HAVING count(R) > 0"""))
def q_calibration(spark, sf):
    """A5 on the residual of the early score."""
    return rounded(st.calibration(stats_frame(spark, sf), "R", ["hour_of_day", "subreddit"]))


@register("lift_by_community_and_hour", _with(f"""
SELECT subreddit, hour_of_day, {R('avg(y)')} AS actual_mean, {R('avg(mid)')} AS pred_mean, CAST(count(*) AS DOUBLE) AS count
FROM bf GROUP BY subreddit, hour_of_day"""))
def q_lift(spark, sf):
    """A6 on a prediction from the score at 15 minutes."""
    return rounded(st.lift_by(baseline_frame(spark, sf), ["subreddit", "hour_of_day"], "y", "mid"))


@register("residual_summary_early_score", _w(f"""
SELECT {R('avg(R)')} AS residual_mean, {R('stddev_samp(R)')} AS residual_std, {R('skewness(R)')} AS residual_skew FROM sfr"""))
def q_summary(spark, sf):
    """Mean, deviation and bias-adjusted skew."""
    return rounded(st.residual_summary(stats_frame(spark, sf), "R"))


@register("stage_targets", _with(f"""
SELECT post_id, {R('s5')} AS score_5m, {R('s30')} AS score_30m, {R('s60')} AS score_60m, {R('ln(1 + s5)')} AS log_score_5m,
  {R('(s30 - s5) / 25.0')} AS velocity_5_to_30m, {R('ln(1 + s60)')} AS stage_a_target
FROM (SELECT p.post_id, greatest(CAST(coalesce(l.score_at_5min, p.score) AS DOUBLE), 0) AS s5, greatest(CAST(coalesce(l.score_at_30min, p.score) AS DOUBLE), 0) AS s30,
        greatest(CAST(coalesce(l.score_at_60min, p.score) AS DOUBLE), 0) AS s60 FROM posts p LEFT JOIN lad l USING (post_id) WHERE p.created_timestamp IS NOT NULL)"""))
def q_targets(spark, sf):
    """M1 / NM13: targets of all platforms' posts, from the score ladder."""
    frame = S.prepare_stage(early_score_features(fx.posts(spark, sf), fx.snapshots(spark, sf)))
    return rounded(frame.select("post_id", "score_5m", "score_30m", "score_60m", "log_score_5m", "velocity_5_to_30m", S.TARGET))


@register("least_squares_by_platform", _with(f"""
SELECT platform, count(*) AS n, {R('regr_slope(y, early)')} AS slope, {R('regr_intercept(y, early)')} AS intercept, {R('regr_r2(y, early)')} AS r2,
  CAST(1 AS BIGINT) AS rank, {R('sqrt((regr_syy(y, early) - regr_sxy(y, early) * regr_sxy(y, early) / regr_sxx(y, early)) / (count(*) - 2) / regr_sxx(y, early))')} AS std_err
FROM bf GROUP BY platform"""))
def q_least_squares(spark, sf):
    """M3 / M4: one pass of Grams by platform; a constant column beside the regressor takes no part."""
    df = baseline_frame(spark, sf).withColumn("fixed", F.lit(53.27))
    rows = []
    for platform, g in G.gram_by_key(df, ["early", "fixed", "y"], "platform").items():
        fit = G.fit_ols(g, ["early", "fixed"], "y")
        m = G.metrics(g, fit, "y")
        rows.append((platform, m["n"], float(fit.coef[0]), fit.intercept, m["r2"], fit.extra["rank"], float(fit.extra["std_err"][0])))
    return rounded(spark.createDataFrame(rows, "platform string, n long, slope double, intercept double, r2 double, rank long, std_err double"))


_WITHIN = """SELECT subreddit, count(*) AS n, avg(y) AS my, avg(early) AS mx, sum(early * early) - sum(early) * sum(early) / count(*) AS sxx,
  sum(early * y) - sum(early) * sum(y) / count(*) AS sxy, sum(y * y) - sum(y) * sum(y) / count(*) AS syy FROM bf GROUP BY subreddit"""


@register("community_fixed_effects", _with(f"""
SELECT subreddit, n, {R('my - slope * mx')} AS effect, {R('(my - slope * mx) - first_value(my - slope * mx) OVER (ORDER BY subreddit)')} AS coef,
  {R('slope')} AS slope, {R('std_err')} AS std_err
FROM wi, (SELECT sum(sxy) / sum(sxx) AS slope, sqrt((sum(syy) - sum(sxy) * sum(sxy) / sum(sxx)) / (sum(n) - count(*) - 1) / sum(sxx)) AS std_err FROM wi)""", wi=_WITHIN))
def q_fixed_effects(spark, sf):
    """M2–M4: the score at 60 minutes on the early score and the community as a factor of any number of levels."""
    fit, effects, base = X.fit_with_factor(baseline_frame(spark, sf), "subreddit", ["early"], "y")
    return rounded(effects.select(
        F.col("level").alias("subreddit"), F.round("n").cast("long").alias("n"), F.col("e0").alias("effect"), (F.col("e0") - F.lit(base[0])).alias("coef"),
        F.lit(float(fit.coef[0])).alias("slope"), F.lit(float(fit.extra["std_err"][0])).alias("std_err")))


@register("fixed_coefficient_predictions", _with(f"""
SELECT post_id, {R('0.25 + 0.75 * early + 0.125 * mid')} AS pred, {R('y - (0.25 + 0.75 * early + 0.125 * mid)')} AS residual FROM bf"""))
def q_fixed(spark, sf):
    """A fitted model as one projection."""
    fit = G.LinearFit(["early", "mid"], [0.75, 0.125], 0.25, 0.0, {})
    df = baseline_frame(spark, sf).withColumn("pred", fit.predict_expr())
    return rounded(df.select("post_id", "pred", (F.col("y") - F.col("pred")).alias("residual")))


@register("expanding_daily_blocks", _with("""
SELECT CAST(day AS VARCHAR) AS day, test_count, CAST(coalesce(sum(test_count) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS train_count
FROM (SELECT CAST(hour_bucket AS DATE) AS day, count(*) AS test_count FROM bf WHERE hour_bucket IS NOT NULL GROUP BY 1)"""))
def q_blocks(spark, sf):
    """Every day with the rows before it."""
    return st.expanding_blocks(baseline_frame(spark, sf), "hour_bucket").select(F.col("day").cast("string").alias("day"), "test_count", "train_count")


_DAILY = """SELECT CAST(CAST(hour_bucket AS DATE) AS VARCHAR) AS block, sqrt(avg((y - early) * (y - early))) AS a, sqrt(avg((y - mid) * (y - mid))) AS b
  FROM bf WHERE hour_bucket IS NOT NULL GROUP BY 1"""


def _daily(spark, sf):
    e, m = F.col("y") - F.col("early"), F.col("y") - F.col("mid")
    df = baseline_frame(spark, sf).where("hour_bucket IS NOT NULL")
    return df.groupBy(F.to_date("hour_bucket").cast("string").alias("block")).agg(
        F.sqrt(F.avg(e * e)).alias("stage_a_test_rmse"), F.sqrt(F.avg(m * m)).alias("stage_b_test_rmse"))


@register("daily_gain_tables", _with(f"""
SELECT 'top' AS "table", block, {R('a - b')} AS rmse_gain FROM (SELECT *, row_number() OVER (ORDER BY round(a - b, 9) DESC, block) AS i FROM dd) WHERE i <= 5
UNION ALL SELECT 'bottom', block, {R('a - b')} FROM (SELECT *, row_number() OVER (ORDER BY round(a - b, 9), block) AS i FROM dd) WHERE i <= 5""", dd=_DAILY))
def q_daily_gain(spark, sf):
    """The days on which the later score helps most and least (errors rounded to nine places, so ties are ties)."""
    d = _daily(spark, sf).select("block", F.round(F.col("stage_a_test_rmse") - F.col("stage_b_test_rmse"), 9).alias("stage_a_test_rmse"), F.lit(0.0).alias("stage_b_test_rmse"))
    _, top, bottom = ev.gain_tables(d)
    pick = lambda t, name: t.select(F.lit(name).alias("table"), "block", "rmse_gain")
    return rounded(pick(top, "top").unionByName(pick(bottom, "bottom")))


@register("trimmed_daily_metrics", _with(f"""
SELECT metric, {R('avg(value)')} AS mean, {R('stddev_samp(value)')} AS std, count(*) AS n
FROM (SELECT metric, value, row_number() OVER (PARTITION BY metric ORDER BY value) AS i, count(*) OVER (PARTITION BY metric) AS n
  FROM (SELECT 'stage_a_test_rmse' AS metric, a AS value FROM dd UNION ALL SELECT 'stage_b_test_rmse', b FROM dd))
WHERE i > floor(n * 0.1) AND i <= n - floor(n * 0.1) GROUP BY metric""", dd=_DAILY))
def q_trimmed_daily(spark, sf):
    """Trimmed mean and deviation of every metric of the daily records."""
    return rounded(D.summarize(_daily(spark, sf), frac=0.1))


@register("model_comparison_top_two", _with(f"""
SELECT CAST(rank AS INTEGER) AS rank, model, {R('rmse')} AS rmse FROM (SELECT model, rmse, row_number() OVER (ORDER BY rmse, model) AS rank FROM (
  SELECT 'early' AS model, sqrt(avg((y - early) * (y - early))) AS rmse FROM bf UNION ALL SELECT 'mid', sqrt(avg((y - mid) * (y - mid))) FROM bf
  UNION ALL SELECT 'mean', sqrt(avg((y - m) * (y - m))) FROM bf, (SELECT avg(y) AS m FROM bf))) WHERE rank <= 2"""))
def q_top_two(spark, sf):
    """All predictions by error, the best two."""
    df = baseline_frame(spark, sf)
    mean = df.agg(F.avg("y").alias("mean"))  # one row
    long = ev.unpivot_models(df.crossJoin(F.broadcast(mean)), "y", {**MODELS, "mean": "mean"}, [])
    table = ev.error_metrics(long, "y", "pred", ["model"])
    best = ev.compare_models(table, 2).withColumn("rank", F.row_number().over(Window.orderBy("rmse", "model")))  # two rows
    return rounded(best.select("rank", "model", "rmse"))


@register("variants_ranked", _with(f"""
SELECT CAST(row_number() OVER (ORDER BY score DESC, idx) AS INTEGER) AS rank, idx AS "index", {R('score')} AS score
FROM (SELECT 0 AS idx, -sqrt(avg((y - early) * (y - early))) AS score FROM bf UNION ALL SELECT 1, -sqrt(avg((y - mid) * (y - mid))) FROM bf)"""))
def q_ranked(spark, sf):
    """Results by score, the earlier one first among equals."""
    e, m = F.col("y") - F.col("early"), F.col("y") - F.col("mid")
    row = baseline_frame(spark, sf).agg((-F.sqrt(F.avg(e * e))).alias("s0"), (-F.sqrt(F.avg(m * m))).alias("s1"))
    pairs = F.array(*[F.struct(F.lit(i).alias("index"), F.col(f"s{i}").alias("score")) for i in (0, 1)])
    return rounded(st.rank_results(row.select(F.explode(pairs).alias("p")).select("p.*"), "score").select("rank", "index", "score"))


@register("coefficients_compared", _with(f"""
SELECT coalesce(a.lang, b.lang) AS feature, {R('a.s')} AS coef_raw, {R('b.s')} AS coef_centered, {R('b.s - a.s')} AS coef_diff
FROM (SELECT lang, regr_slope(y, early) AS s FROM bf WHERE lang <> 'de' GROUP BY lang) a
FULL JOIN (SELECT lang, regr_slope(y, mid) AS s FROM bf WHERE lang <> 'en' GROUP BY lang) b ON a.lang = b.lang"""))
def q_compared(spark, sf):
    """Two coefficient tables side by side, features of either."""
    df = baseline_frame(spark, sf)
    slopes = lambda x, without: df.where(F.col("lang") != without).groupBy(F.col("lang").alias("feature")).agg(F.regr_slope("y", x).alias("coef"))
    return rounded(compare_coefs(slopes("early", "de"), slopes("mid", "en")))
