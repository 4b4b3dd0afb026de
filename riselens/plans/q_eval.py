"""Registered evaluation queries with SQL oracles.

The evaluated "models" here are deterministic early-score predictors of the
60-minute outcome (log1p of the 5- and 15-minute scores), so the independent
engine can recompute every metric, pair count and table exactly.  The fitted
two-stage models are evaluated by the same operators in ``q_models``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from riselens.functions.context import epoch_to_ts
from riselens.operators import evaluate as ev
from riselens.operators.pairwise import pairwise_accuracy, pairwise_report, pairwise_signs
from riselens.operators.snapshots import early_score_features
from riselens.plans import oracle_sql as O
from riselens.plans.registry import register, round_sql, rounded
from riselens.sources import fixtures as fx

MODELS = {"early": "early", "mid": "mid"}
BASELINE = "early"
CAP = 30
SEED = 42


def baseline_frame(spark, sf):
    j = early_score_features(fx.posts(spark, sf), fx.snapshots(spark, sf))
    ts = epoch_to_ts("created_timestamp")
    return j.select(
        "post_id", "platform", "lang", "subreddit", "created_timestamp",
        F.log1p(F.col("score_at_60min")).alias("y"),
        F.log1p(F.col("score_at_5min")).alias("early"),
        F.log1p(F.col("score_at_15min")).alias("mid"),
        F.date_trunc("hour", ts).alias("hour_bucket"),
        F.hour(ts).alias("hour_of_day"), F.weekday(ts).alias("day_of_week"),
    )


_BF = {
    "lad": O.ladder_sql(),
    "bf": f"""SELECT p.post_id, p.platform, p.lang, p.subreddit, p.created_timestamp,
        ln(1 + coalesce(l.score_at_60min, p.score)) AS y, ln(1 + coalesce(l.score_at_5min, p.score)) AS early,
        ln(1 + coalesce(l.score_at_15min, p.score)) AS mid,
        date_trunc('hour', {O.ts_from_epoch('p.created_timestamp')}) AS hour_bucket,
        hour({O.ts_from_epoch('p.created_timestamp')}) AS hour_of_day,
        isodow({O.ts_from_epoch('p.created_timestamp')}) - 1 AS day_of_week
      FROM posts p LEFT JOIN lad l USING (post_id)""",
}


def _with(body, **extra):
    return fx.sql_with(body, "posts", "snapshots", extra={**_BF, **extra})


def _metric_sql(y: str, p: str) -> str:
    e = f"({y} - {p})"
    return (f"count(*) AS n, {round_sql(f'sqrt(avg({e} * {e}))')} AS rmse, {round_sql(f'avg(abs({e}))')} AS mae, "
            f"{round_sql(f'1 - sum({e} * {e}) / nullif(sum({y} * {y}) - sum({y}) * sum({y}) / count(*), 0)')} AS r2, "
            f"{round_sql(f'avg({e})')} AS residual_mean, {round_sql(f'stddev_samp({e})')} AS residual_std")


_LONG = "SELECT platform, 'early' AS model, y, early AS pred FROM bf UNION ALL SELECT platform, 'mid', y, mid FROM bf"


@register("error_metrics_by_platform", _with(f"SELECT platform, model, {_metric_sql('y', 'pred')} FROM lg GROUP BY platform, model",
                                             lg=_LONG))
def q_error_metrics(spark, sf):
    long = ev.unpivot_models(baseline_frame(spark, sf), "y", MODELS, ["platform"])
    return rounded(ev.error_metrics(long, "y", "pred", ["platform", "model"]))


_VAR = f"""SELECT model, {_metric_sql('y', 'pred')}, sqrt(avg((y - pred) * (y - pred))) AS rmse_raw FROM lg GROUP BY model"""


@register("variant_table", _with(f"""
SELECT v.model, v.n, v.rmse, v.mae, v.r2, v.residual_mean, v.residual_std,
  {round_sql('b.rmse_raw - v.rmse_raw')} AS rmse_delta_vs_baseline
FROM ({_VAR}) v CROSS JOIN (SELECT rmse_raw FROM ({_VAR}) WHERE model = '{BASELINE}') b""",
                                 lg=_LONG.replace("platform, ", "").replace("SELECT 'early'", "SELECT 'early'")))
def q_variant_table(spark, sf):
    return rounded(ev.variant_table(baseline_frame(spark, sf), "y", MODELS, BASELINE))


@register("gain_pivot_metric_by_model", _with(f"""
SELECT metric, max(CASE WHEN model = 'early' THEN value END) AS early, max(CASE WHEN model = 'mid' THEN value END) AS mid
FROM (SELECT model, 'rmse' AS metric, rmse AS value FROM ({_VAR}) UNION ALL SELECT model, 'mae', mae FROM ({_VAR}))
GROUP BY metric""", lg=_LONG.replace("platform, ", "")))
def q_gain_pivot(spark, sf):
    v = rounded(ev.variant_table(baseline_frame(spark, sf), "y", MODELS, BASELINE))
    return ev.gain_pivot(v, ("rmse", "mae"), list(MODELS))


@register("hash_split_labels", fx.sql_with("""
SELECT post_id, CASE WHEN b < 7000 THEN 'train' WHEN b < 8500 THEN 'val' ELSE 'test' END AS split
FROM (SELECT post_id, CAST(('0x' || substr(md5(post_id || '|42'), 1, 8)) AS BIGINT) % 10000 AS b FROM posts)""", "posts"))
def q_hash_split(spark, sf):
    return ev.hash_split(fx.posts(spark, sf).select("post_id"), seed=SEED).select("post_id", "split")


#: Two-sided p-value of t with v degrees of freedom: Simpson's rule on the integral
#: of cos^(v-1) from 0 to atan(t / sqrt(v)), in 4000 steps.
_T_P_SQL = """1 - 2 / sqrt(pi()) * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) * a / 12000 *
  list_sum(list_transform(range(0, 4001), lambda i: (CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(a * i / 4000), v - 1)))"""


@register("paired_t_abs_errors", _with(f"""
SELECT n, {round_sql('mean_diff')} AS mean_diff, {round_sql('t')} AS t_stat, {round_sql(_T_P_SQL)} AS p_value
FROM (SELECT *, CAST(n - 1 AS DOUBLE) AS v, atan(abs(t) / sqrt(n - 1)) AS a FROM (
  SELECT count(d) AS n, avg(d) AS mean_diff, avg(d) / (stddev_samp(d) / sqrt(count(d))) AS t
  FROM (SELECT (y - early) - (y - mid) AS d FROM bf)))"""))
def q_paired_t(spark, sf):
    """The paired t of the residuals of two predictions, with its p-value (the name is kept from its first form)."""
    return rounded(ev.paired_t(baseline_frame(spark, sf), "y", "early", "mid"))


@register("pairwise_accuracy_lang_hour", _with(f"""
SELECT CAST(coalesce(sum(CASE WHEN (a.y - b.y) * (a.mid - b.mid) > 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS concordant,
       CAST(count(*) AS BIGINT) AS pairs,
       {round_sql('sum(CASE WHEN (a.y - b.y) * (a.mid - b.mid) > 0 THEN 1 ELSE 0 END) / nullif(count(*), 0)')} AS pairwise_accuracy
FROM bf a JOIN bf b ON a.lang = b.lang AND a.hour_bucket = b.hour_bucket AND a.post_id < b.post_id
WHERE a.y <> b.y AND a.mid <> b.mid"""))
def q_pairwise_accuracy(spark, sf):
    return rounded(pairwise_accuracy(baseline_frame(spark, sf), ["lang", "hour_bucket"], "y", "mid"))


@register("pairwise_accuracy_by_lang", _with(f"""
SELECT l.lang, CAST(coalesce(c.conc, 0) AS BIGINT) AS concordant, CAST(coalesce(c.pairs, 0) AS BIGINT) AS pairs,
       {round_sql('c.conc / nullif(c.pairs, 0)')} AS pairwise_accuracy
FROM (SELECT DISTINCT lang FROM bf) l JOIN (
  SELECT a.lang, sum(CASE WHEN (a.y - b.y) * (a.early - b.early) > 0 THEN 1 ELSE 0 END) AS conc, count(*) AS pairs
  FROM bf a JOIN bf b ON a.lang = b.lang AND a.hour_bucket = b.hour_bucket AND a.post_id < b.post_id
  WHERE a.y <> b.y AND a.early <> b.early GROUP BY a.lang) c ON c.lang = l.lang"""))
def q_pairwise_by_lang(spark, sf):
    return rounded(pairwise_accuracy(baseline_frame(spark, sf), ["lang", "hour_bucket"], "y", "early", by=["lang"]))


_CAPPED = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subreddit, day_of_week, hour_of_day
              ORDER BY md5(post_id || '|{SEED}'), post_id) AS rn FROM bf) WHERE rn <= {CAP}"""
_SIGNS = """SELECT subreddit, day_of_week, hour_of_day, model, CAST(sum(ok) AS BIGINT) AS correct, CAST(count(*) AS BIGINT) AS pairs
FROM (SELECT a.subreddit, a.day_of_week, a.hour_of_day, m.model,
             CAST(sign(CASE m.model WHEN 'early' THEN a.early - b.early ELSE a.mid - b.mid END) = sign(a.y - b.y) AS INTEGER) AS ok
      FROM cp a JOIN cp b ON a.subreddit = b.subreddit AND a.day_of_week = b.day_of_week
           AND a.hour_of_day = b.hour_of_day AND a.post_id < b.post_id
      CROSS JOIN (VALUES ('early'), ('mid')) m(model)
      WHERE abs(a.y - b.y) > 1e-8)
GROUP BY subreddit, day_of_week, hour_of_day, model"""


def _signs(spark, sf):
    return pairwise_signs(baseline_frame(spark, sf), ["subreddit", "day_of_week", "hour_of_day"], "y",
                          list(MODELS), cap=CAP, seed=SEED)


@register("pairwise_signs_capped_groups", _with(_SIGNS, cp=_CAPPED))
def q_pairwise_signs(spark, sf):
    return _signs(spark, sf)


_REPORT = f"""SELECT g.model, g.day_of_week, g.subreddit, g.grain_id, g.correct, g.pairs, {round_sql('g.accuracy')} AS accuracy,
  {round_sql('b.accuracy')} AS baseline_accuracy, {round_sql('g.accuracy - b.accuracy')} AS lift_vs_baseline
FROM gs g LEFT JOIN gs b ON b.model = '{BASELINE}' AND b.grain_id = g.grain_id
  AND b.subreddit IS NOT DISTINCT FROM g.subreddit AND b.day_of_week IS NOT DISTINCT FROM g.day_of_week"""
_GS = f"""SELECT model, day_of_week, subreddit, grouping(day_of_week) * 1 + grouping(subreddit) * 2 AS grain_id,
  CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(pairs) AS BIGINT) AS pairs, sum(correct) / nullif(sum(pairs), 0) AS accuracy
FROM sg GROUP BY GROUPING SETS ((model), (model, subreddit), (model, day_of_week))"""


@register("pairwise_report_grains", _with(_REPORT, cp=_CAPPED, sg=_SIGNS, gs=_GS))
def q_pairwise_report(spark, sf):
    rep = pairwise_report(_signs(spark, sf), [[], ["subreddit"], ["day_of_week"]], baseline=BASELINE)
    return rounded(rep.select("model", "day_of_week", "subreddit", F.col("grain_id").cast("int").alias("grain_id"),
                              "correct", "pairs", "accuracy", "baseline_accuracy", "lift_vs_baseline"))


@register("success_check_overall", _with(f"""
SELECT model, {round_sql('accuracy')} AS accuracy, {round_sql('0.6')} AS target_accuracy,
  coalesce(accuracy >= 0.6, false) AS meets_target, {round_sql('accuracy - 0.6')} AS gap_to_target
FROM gs WHERE grain_id = 3""", cp=_CAPPED, sg=_SIGNS, gs=_GS))
def q_success(spark, sf):
    rep = pairwise_report(_signs(spark, sf), [[], ["subreddit"], ["day_of_week"]])
    overall = rep.filter(F.col("grain_id") == 3).select("model", "accuracy")
    return rounded(ev.success_check(overall))


@register("best_model_per_platform", _with(f"""
SELECT platform, arg_min(model, (rmse, model)) AS model, min(rmse) AS rmse
FROM (SELECT platform, model, {round_sql('sqrt(avg((y - pred) * (y - pred)))')} AS rmse FROM lg GROUP BY platform, model)
GROUP BY platform""", lg=_LONG))
def q_rollup(spark, sf):
    long = ev.unpivot_models(baseline_frame(spark, sf), "y", MODELS, ["platform"])
    m = rounded(ev.error_metrics(long, "y", "pred", ["platform", "model"])).select("platform", "model", "rmse")
    return ev.rollup_tracks(m, "platform", "rmse", "model")


@register("score_deltas_and_lookup", _with(f"""
SELECT b.post_id, {round_sql('exp(b.mid) - exp(b.early)')} AS score_delta_5_15, c.n AS community_posts
FROM bf b JOIN (SELECT subreddit, count(*) AS n FROM bf GROUP BY subreddit) c USING (subreddit)"""))
def q_deltas_lookup(spark, sf):
    """D6 (score deltas) and J7 (lookup through a key table with a checked broadcast)."""
    from riselens.operators.joins import lookup
    from riselens.operators.snapshots import score_deltas
    j = early_score_features(fx.posts(spark, sf), fx.snapshots(spark, sf))
    d = j.withColumns({"score_5m": F.col("score_at_5min"), "score_15m": F.col("score_at_15min"),
                       "score_30m": F.col("score_at_30min"), "score_60m": F.col("score_at_60min")})
    d = d.withColumns(score_deltas())
    sizes = d.groupBy("subreddit").agg(F.count(F.lit(1)).alias("community_posts"))
    out = lookup(d, sizes, "subreddit", "community_posts", default=0)
    return rounded(out.select("post_id", F.col("score_delta_5_15").cast("double"), "community_posts"))


@register("attach_time_inner", _with(f"""
SELECT b.post_id, b.created_timestamp, {round_sql('b.y')} AS y FROM bf b WHERE b.platform = 'reddit'"""))
def q_attach_time(spark, sf):
    """Outputs ⋈ feature timestamps with a null drop (planned as an inner join)."""
    from riselens.operators.joins import attach_time
    bf = baseline_frame(spark, sf)
    outputs = bf.select("post_id", "y")
    feats = bf.select("post_id", F.when(F.col("platform") == "reddit", F.col("created_timestamp")).alias("created_timestamp"))
    return rounded(attach_time(outputs, feats))
