"""Tree models on rows whose features miss values (titles without words)."""

import numpy as np
from pyspark.sql import functions as F

from riselens.operators import models as ML


def _rows(spark, holes):
    """300 rows; every ``holes``-th has no value of ``a``, half of those NaN."""
    d = spark.range(300).select(F.col("id").cast("string").alias("post_id"), (F.col("id") % 7).cast("int").alias("b"),
                                (F.col("id") % 11).cast("double").alias("v"), (F.col("id") % 5 == 0).alias("_valid"))
    gap = F.col("post_id").cast("long") % holes
    a = F.when(gap != 0, F.col("v")).when(F.col("post_id").cast("long") % 2 == 0, F.lit(float("nan")))
    return d.withColumn("a", a).withColumn("y", F.col("v") + F.col("b"))


def test_boosted_takes_missing_features_as_zero(spark):
    d = _rows(spark, 13)
    m = ML.boosted_residual_model(d, ["a", "b"], "y", "_valid", max_iter=2)
    zero = ML.boosted_residual_model(d.withColumn("a", F.coalesce(F.nanvl("a", F.lit(0.0)), F.lit(0.0))), ["a", "b"], "y", "_valid", max_iter=2)
    got, want = (ML.evaluate(x, d, "y") for x in (m, zero))
    assert got["n"] == 300 and got == want
    assert len(m.stages[-1].featureImportances.toArray()) == 2


def test_grid_search_fills_missing_features_with_fold_medians(spark):
    d = _rows(spark, 13)
    grid = {"numTrees": [2], "maxDepth": [2, 3]}
    got = {r["params"]: r["cv_rmse"] for r in ML.grid_search(d, "random_forest", ["a", "b"], "y", grid).collect()}
    # the same by hand: each fold's median from its training rows
    fold = F.pmod(F.xxhash64("post_id", F.lit(42)), F.lit(3))
    want = {2: [], 3: []}
    for f in range(3):
        own = d.withColumn("f", fold)
        values = [r["a"] for r in own.where(f"f <> {f}").collect() if r["a"] is not None and not np.isnan(r["a"])]
        median = float(np.quantile(values, 0.5, method="inverted_cdf"))
        full = own.withColumn("a", F.coalesce(F.nanvl("a", F.lit(median)), F.lit(median)))
        for depth in want:
            rf = ML.regressor("random_forest", label="y", numTrees=2, maxDepth=depth)
            asm = ML.VectorAssembler(inputCols=["a", "b"], outputCol="features")
            fit = rf.fit(asm.transform(full.where(f"f <> {f}")))
            want[depth].append(ML.evaluate(fit, asm.transform(full.where(f"f = {f}")), "y")["rmse"])
    for depth, rmse in want.items():
        assert abs(got[f"[('maxDepth', {depth}), ('numTrees', 2)]"] - np.mean(rmse)) < 1e-6


def test_grid_search_of_a_column_without_values(spark):
    d = _rows(spark, 1).withColumn("a", F.lit(None).cast("double"))
    rows = ML.grid_search(d, "random_forest", ["a", "b"], "y", {"numTrees": [2], "maxDepth": [2]}).collect()
    assert len(rows) == 1 and rows[0]["cv_rmse"] is not None
