"""Registered MLlib model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riselens.operators import evaluate as ev
from riselens.operators import models as ML
from riselens.plans import stage as S
from riselens.plans.q_models import fitted
from riselens.plans.registry import register, rounded

NUMERIC = S.STAGE_A_CONTEXT_COLS + S.STAGE_B_TITLE_COLS
CATEGORICAL = ["subreddit", "platform"]
TARGET = "stage_a_residual"


def _split(spark, sf):
    _, scored, _ = fitted(spark, sf)
    return ev.hash_split(scored, "post_id", seed=42)


@register("tabular_model_comparison")
def q_tabular(spark, sf):
    """M13–M15 + E15: linear / random forest / boosted trees on the
    preprocessing pipeline, 70/15/15 hash split, ranked by test RMSE."""
    d = _split(spark, sf)
    train, test = d.filter(F.col("split") == "train"), d.filter(F.col("split") == "test")
    rows = []
    for kind, params in (("linear", {}), ("random_forest", {"numTrees": 40, "maxDepth": 6}),
                         ("gbt", {"maxIter": 40, "maxDepth": 3, "stepSize": 0.1})):
        m = ML.fit_trees(train, kind, NUMERIC, CATEGORICAL, TARGET, **params)
        e = ML.evaluate(m, test, TARGET)
        rows.append((kind, e["rmse"], e["mae"], e["r2"], e["n"]))
    out = spark.createDataFrame(rows, "model string, rmse double, mae double, r2 double, n long")
    return rounded(out.orderBy("rmse", "model"))


@register("boosted_residual_early_stopping")
def q_boosted(spark, sf):
    """Boosted residual model, early stopping on the last 15% of train."""
    _, scored, info = fitted(spark, sf)
    n_train = info["train_count"]
    d = scored.withColumn("_valid", F.col("time_rank") >= F.lit(int(n_train * 0.85)))
    train = d.filter(F.col("split") == "train")
    feats = S.STAGE_B_TITLE_COLS + S.STAGE_B_INTERACTION_COLS
    m = ML.boosted_residual_model(train, feats, TARGET, "_valid", max_iter=60)
    rows = [(split, *ML.evaluate(m, d.filter(F.col("split") == split), TARGET).values()) for split in ("train", "test")]
    imp = m.stages[-1].featureImportances.toArray()
    top = sorted(zip(feats, imp), key=lambda x: (-x[1], x[0]))[:10]   # names aligned with the model's inputs (Q4 fixed)
    out = spark.createDataFrame(rows, "split string, rmse double, mae double, r2 double, n long")
    return rounded(out.withColumn("top_features", F.lit(", ".join(f"{f}:{v:.4f}" for f, v in top))))


@register("permutation_importance")
def q_permutation(spark, sf):
    d = _split(spark, sf)
    train, test = d.filter(F.col("split") == "train"), d.filter(F.col("split") == "test")
    feats = S.STAGE_B_TITLE_COLS
    m = ML.fit_trees(train, "linear", feats, [], TARGET)
    return rounded(ML.permutation_importance(m, test, feats, TARGET, repeats=15, seed=42))


@register("cv_grid_search")
def q_grid(spark, sf):
    d = _split(spark, sf)
    train = d.filter(F.col("split") != "test")
    return rounded(ML.grid_search(train, "random_forest", S.STAGE_B_TITLE_COLS, TARGET,
                                  {"numTrees": [10, 20], "maxDepth": [3, 5]}, folds=3))


@register("paired_t_stage_models")
def q_paired_stage(spark, sf):
    """E16 on the fitted models: Stage A alone vs Stage A + Stage B."""
    _, scored, _ = fitted(spark, sf)
    t = scored.filter(F.col("split") == "test")
    return rounded(ev.paired_t(t, S.TARGET, "stage_a_pred", "combined_pred"))
