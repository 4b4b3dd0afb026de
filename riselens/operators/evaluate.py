"""Evaluation operators: error metrics (E1), variant tables (E5, E6, E15),
hash split (E14), paired t (E16), success check (E17), roll-up (E18) and gain
tables (E19).  All are single aggregates or projections over prediction
columns; models are unpivoted with ``stack`` so every model is scored in one
``groupBy``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riselens.functions.special import student_t_two_sided

SUCCESS_TARGET = 0.60


def _metric_aggs(y: Column, pred: Column) -> list[Column]:
    e = y - pred
    n = F.count(e)
    sst = n * F.var_pop(y)
    return [
        n.alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (F.lit(1.0) - F.sum(e * e) / F.when(sst > 0, sst)).alias("r2"),
        F.avg(e).alias("residual_mean"),
        F.stddev_samp(e).alias("residual_std"),
    ]


def error_metrics(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """N, RMSE, MAE, R² (and residual mean / std) per group."""
    yy, pp = F.col(y).cast("double"), F.col(pred).cast("double")
    ok = df.filter(yy.isNotNull() & pp.isNotNull())
    return ok.groupBy(*by).agg(*_metric_aggs(yy, pp))


def unpivot_models(df: DataFrame, y: str, preds: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form (keep..., model, y, pred) of several prediction columns."""
    items = F.array(*[F.struct(F.lit(name).alias("model"), F.col(col).cast("double").alias("pred"))
                      for name, col in preds.items()])
    return df.select(*keep, F.col(y).cast("double").alias("y"), F.explode(items).alias("m")).select(
        *keep, "m.model", "y", "m.pred")


def variant_table(df: DataFrame, y: str, preds: dict[str, str], baseline: str, by: Sequence[str] = ()) -> DataFrame:
    """E5: per model RMSE / MAE / residual mean / std, RMSE delta vs baseline."""
    long = unpivot_models(df, y, preds, by).filter(F.col("y").isNotNull() & F.col("pred").isNotNull())
    m = long.groupBy(*by, "model").agg(*_metric_aggs(F.col("y"), F.col("pred")))
    base = m.filter(F.col("model") == baseline).select(*by, F.col("rmse").alias("_base_rmse"))
    out = m.join(base, list(by), "left") if by else m.crossJoin(F.broadcast(base))
    return out.withColumn("rmse_delta_vs_baseline", F.col("_base_rmse") - F.col("rmse")).drop("_base_rmse")


def gain_pivot(variants: DataFrame, metrics: Sequence[str] = ("rmse", "mae"), models: Sequence[str] | None = None) -> DataFrame:
    """Metric × model layout (pivot over a fixed model list)."""
    long = variants.select("model", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("s")
    ).select("model", "s.metric", "s.value")
    g = long.groupBy("metric")
    return (g.pivot("model", list(models)) if models is not None else g.pivot("model")).agg(F.first("value"))


def compare_models(variants: DataFrame, k: int = 2) -> DataFrame:
    """Models sorted by RMSE (ties by name), best ``k``."""
    return variants.orderBy(F.col("rmse").asc_nulls_last(), F.col("model")).limit(k)


def hash_bucket(key: Column | str, seed: int = 42, buckets: int = 100) -> Column:
    """Reproducible, partition-independent bucket of a key from md5."""
    k = F.col(key) if isinstance(key, str) else key
    h = F.conv(F.substring(F.md5(F.concat_ws("|", k.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    return h % F.lit(buckets)


def hash_split(df: DataFrame, key: str = "post_id", weights: Sequence[float] = (0.7, 0.15, 0.15),
               names: Sequence[str] = ("train", "val", "test"), seed: int = 42) -> DataFrame:
    """Train / validation / test labels from a hash of the id."""
    b = hash_bucket(key, seed, 10_000)
    cuts, acc = [], 0.0
    for w in weights:
        acc += w
        cuts.append(int(round(acc * 10_000)))
    expr = None
    for cut, name in zip(cuts, names):
        expr = F.when(b < cut, F.lit(name)) if expr is None else expr.when(b < cut, F.lit(name))
    return df.withColumn("split", expr.otherwise(F.lit(names[-1])))


def paired_t(df: DataFrame, y: str, pred_a: str, pred_b: str) -> DataFrame:
    """Paired t on the signed residuals of two models (n, mean difference, t, two-sided p-value).

    Fewer than two rows, or equal differences, have no t and no p-value.
    """
    d = (F.col(y) - F.col(pred_a)) - (F.col(y) - F.col(pred_b))
    n, spread = F.count(d), F.stddev_samp(d)
    row = df.agg(n.alias("n"), F.avg(d).alias("mean_diff"), F.when(spread > 0, F.avg(d) / (spread / F.sqrt(n))).alias("t_stat"))

    def with_p(batches):
        for pdf in batches:
            t = pdf["t_stat"].to_numpy(dtype=np.float64)
            yield pdf.assign(p_value=student_t_two_sided(t, pdf["n"].to_numpy(dtype=np.float64) - 1))

    out = row.mapInPandas(with_p, "n long, mean_diff double, t_stat double, p_value double")  # one row
    return out.withColumn("p_value", F.nanvl("p_value", F.lit(None).cast("double")))


def success_check(report: DataFrame, accuracy: str = "accuracy", target: float = SUCCESS_TARGET) -> DataFrame:
    """Flag rows whose pairwise accuracy reaches the target."""
    return report.withColumns({
        "target_accuracy": F.lit(target),
        "meets_target": F.coalesce(F.col(accuracy) >= F.lit(target), F.lit(False)),
        "gap_to_target": F.col(accuracy) - F.lit(target),
    })


def rollup_tracks(results: DataFrame, track: str = "track", metric: str = "rmse", tie: str = "model") -> DataFrame:
    """Best row per track (min metric, tie by model name) in one aggregate."""
    row = F.struct(*[F.col(c) for c in results.columns if c != track])
    best = results.groupBy(track).agg(F.min_by(row, F.struct(F.col(metric), F.col(tie))).alias("b"))
    return best.select(track, "b.*")


def gain_tables(blocks: DataFrame, a: str = "stage_a_test_rmse", b: str = "stage_b_test_rmse",
                key: str = "block", k: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per-block gain (A − B RMSE); top and bottom ``k`` blocks."""
    g = blocks.withColumn("rmse_gain", F.col(a) - F.col(b))
    top = g.orderBy(F.col("rmse_gain").desc_nulls_last(), F.col(key)).limit(k)
    bottom = g.orderBy(F.col("rmse_gain").asc_nulls_last(), F.col(key)).limit(k)
    return g, top, bottom
