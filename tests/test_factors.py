"""Fits with an eliminated factor against dummies and direct least squares."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riselens.operators import factors as X
from riselens.operators import gram as G


def case(seed, n=400, levels=12):
    rng = np.random.default_rng(seed)
    g = np.where(rng.random(n) < 0.4, 0, rng.integers(0, levels, n))
    pdf = pd.DataFrame({"g": [f"c{v:02d}" for v in g], "a": rng.normal(size=n), "b": rng.normal(5, 3, size=n), "flag": (rng.random(n) < 0.3).astype(float)})
    pdf["const"] = 53.27
    pdf["by_level"] = g * 1.7 + 0.3  # constant within a level
    pdf["y"] = 2 * pdf["a"] - 0.5 * pdf["b"] + g * 0.25 + pdf["flag"] * (g % 3) + rng.normal(size=n)
    return pdf


def dummies(pdf, x, slope=None):
    lv = sorted(pdf["g"].unique())
    cols = [np.ones(len(pdf))] + [pdf[c].to_numpy() for c in x] + [(pdf["g"] == v).to_numpy(float) for v in lv[1:]]
    if slope:
        cols += [(pdf["g"] == v).to_numpy(float) * pdf[slope].to_numpy() for v in lv]
    return np.stack(cols, 1), lv


def test_slopes_effects_and_errors_equal_dummies(spark):
    pdf = case(1)
    df = spark.createDataFrame(pdf).repartition(5)
    fit, effects, base = X.fit_with_factor(df, "g", ["a", "b", "const", "by_level"], "y")
    A, lv = dummies(pdf, ["a", "b"])
    coef, *_ = np.linalg.lstsq(A, pdf["y"].to_numpy(), rcond=None)
    resid = pdf["y"].to_numpy() - A @ coef
    sigma2 = resid @ resid / (len(pdf) - A.shape[1])
    se = np.sqrt(np.diag(np.linalg.inv(A.T @ A)) * sigma2)
    assert np.allclose(fit.coef[:4], [*coef[1:3], 0, 0], atol=1e-9) and fit.coef[4] == 1
    assert np.allclose(fit.extra["std_err"][:2], se[1:3]) and np.isnan(fit.extra["std_err"][2:]).all()
    assert fit.extra["rss"] == pytest.approx(resid @ resid) and fit.extra["rank"] == A.shape[1] - 1
    got = {r["level"]: r["e0"] for r in effects.collect()}
    assert np.allclose([got[v] for v in lv], coef[0] + np.concatenate(([0], coef[3:])), atol=1e-8)
    assert base == pytest.approx([coef[0]], abs=1e-8)


def test_rows_get_the_effects_and_unseen_levels_the_first(spark):
    pdf = case(2)
    df = spark.createDataFrame(pdf)
    fit, effects, base = X.fit_with_factor(df, "g", ["a", "b"], "y")
    A, lv = dummies(pdf, ["a", "b"])
    coef, *_ = np.linalg.lstsq(A, pdf["y"].to_numpy(), rcond=None)
    new = pd.concat([pdf.assign(i=range(len(pdf))), pd.DataFrame({"g": ["new", None], "a": [1.0, 2.0], "b": [0.0, 1.0], "i": [1000, 1001]})])
    rows = X.attach_effect(spark.createDataFrame(new[["i", "g", "a", "b"]]), "g", effects, "all", base).withColumn("p", fit.predict_expr())
    got = rows.select("i", "p").toPandas().sort_values("i")["p"].to_numpy()
    assert np.allclose(got[:-2], A @ coef, atol=1e-8)
    assert np.allclose(got[-2:], [coef[0] + coef[1], coef[0] + 2 * coef[1] + coef[2]], atol=1e-8)


def test_own_slopes_equal_interactions(spark):
    pdf = case(3)
    df = spark.createDataFrame(pdf)
    fit, effects, _ = X.fit_with_factor(df, "g", ["a", "b"], "y", by=["flag"])
    A, lv = dummies(pdf, ["a", "b"], "flag")
    coef, *_ = np.linalg.lstsq(A, pdf["y"].to_numpy(), rcond=None)
    assert np.allclose(fit.coef[:2], coef[1:3], atol=1e-8)
    slopes = {r["level"]: r["e1"] for r in effects.collect()}
    assert np.allclose([slopes[v] for v in lv], coef[-len(lv):], atol=1e-8)


def test_effect_column_of_a_gram_equals_rows(spark):
    """Fits of several keys at once, and Grams of other rows than those fitted."""
    pdf = pd.concat([case(4).assign(k="p"), case(5).assign(k="q")]).reset_index(drop=True)
    pdf["part"] = np.where(np.arange(len(pdf)) % 4 == 0, "test", "train")
    pdf.loc[pdf.index[:3], "g"] = "zz"  # a level that only test rows of one fit may hold
    df = spark.createDataFrame(pdf)
    cols = ["a", "b", "y"]
    levels = X.checkpoint(X.level_sums(df, "g", cols, fit=F.col("k"), part=F.col("part")))
    train = X.merge_parts(levels.where("part = 'train'"))
    grams = G.gram_by_key(df, cols, F.concat_ws("|", "k", "part"))
    between = X.between_grams(train, cols)
    fits = {k: X.fit_absorbed(grams[f"{k}|train"], *between[k], ["a", "b"], "y") for k in "pq"}
    effects = X.level_effects(train, fits, cols, "y")
    base = X.base_effects(effects)
    moments = X.effect_moments(levels, effects, base, cols)
    table = {(r["fit"], r["level"]): r["e0"] for r in effects.collect()}
    for k in "pq":
        for part in ("train", "test"):
            own = pdf[(pdf["k"] == k) & (pdf["part"] == part)]
            e = np.array([table.get((k, v), base[k][0]) for v in own["g"]])
            u = np.column_stack([np.ones(len(own)), own[cols], e])
            assert np.allclose(X.with_effect(grams[f"{k}|{part}"], moments[k, part]).U, u.T @ u)


def test_fifty_thousand_levels(spark):
    """More levels than a dense Gram could hold; slopes known by construction."""
    n = 200_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("c"), (F.col("id") % 50_000).cast("string"))).alias("g"),
        ((F.col("id") * 7919 % 1009) / 100.0).alias("a"), ((F.col("id") * 104729 % 997) / 50.0).alias("b"))
    df = df.withColumn("y", 3 * F.col("a") - 2 * F.col("b") + (F.crc32(F.col("g").cast("binary")) % 100) / 10.0)
    fit, effects, _ = X.fit_with_factor(df, "g", ["a", "b"], "y")
    assert np.allclose(fit.coef[:2], [3, -2], atol=1e-7)
    assert effects.count() > 45_000
    worst = effects.agg(F.max(F.abs(F.col("e0") - (F.crc32(F.col("level").cast("binary")) % 100) / 10.0))).first()[0]
    assert worst < 1e-6


@pytest.mark.parametrize("scale", [1e-6, 1.0, 1e3, 1e9])
def test_constant_columns_do_not_count(scale):
    """Constants that are not integers, beside columns of any scale; also one that varies elsewhere."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=300) * scale
    y = 5 + 0.0 * x + rng.normal(size=300)
    X_ = np.column_stack([x, np.full(300, 53.27), np.full(300, 0.1), np.full(300, 1e6 / 3)])
    u = np.column_stack([np.ones(300), X_, y])
    fit = G.fit_ols(G.AugGram(["x", "c1", "c2", "c3", "y"], u.T @ u), ["x", "c1", "c2", "c3"], "y")
    b, a = np.polyfit(x, y, 1)
    assert fit.extra["rank"] == 1 and fit.coef[1:].tolist() == [0, 0, 0]
    assert fit.coef[0] == pytest.approx(b, rel=1e-6) and fit.intercept == pytest.approx(a)
    assert fit.extra["sigma2"] == pytest.approx(np.sum((y - a - b * x) ** 2) / 298)
