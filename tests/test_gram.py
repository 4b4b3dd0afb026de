"""Gram-based solvers against direct numpy solutions."""

import numpy as np
import pandas as pd
import pytest

from riselens.operators import gram as G


def _gram(X, y):
    u = np.hstack([np.ones((len(X), 1)), X, y[:, None]])
    return G.AugGram([f"x{i}" for i in range(X.shape[1])] + ["y"], u.T @ u)


def test_ols_matches_lstsq():
    rng = np.random.default_rng(0)
    X = rng.normal(size=(300, 6))
    y = X @ rng.normal(size=6) + 2 + rng.normal(size=300)
    fit = G.fit_ols(_gram(X, y), [f"x{i}" for i in range(6)], "y")
    A = np.hstack([np.ones((300, 1)), X])
    coef = np.linalg.lstsq(A, y, rcond=None)[0]
    assert fit.intercept == pytest.approx(coef[0], abs=1e-9)
    assert np.allclose(fit.coef, coef[1:], atol=1e-9)
    m = G.metrics(_gram(X, y), fit, "y")
    resid = y - A @ coef
    assert m["rmse"] == pytest.approx(np.sqrt(np.mean(resid ** 2)))


def test_singular_design_predictions_stable():
    rng = np.random.default_rng(1)
    X = rng.normal(size=(200, 3))
    X = np.hstack([X, X[:, :1] + X[:, 1:2]])          # exact collinearity
    y = X[:, 0] - X[:, 2] + rng.normal(size=200)
    fit = G.fit_ols(_gram(X, y), [f"x{i}" for i in range(4)], "y")
    A = np.hstack([np.ones((200, 1)), X])
    pred = A @ np.concatenate([[fit.intercept], fit.coef])
    pred_ls = A @ np.linalg.lstsq(A, y, rcond=None)[0]
    assert np.allclose(pred, pred_ls, atol=1e-8)


def test_elastic_net_kkt():
    rng = np.random.default_rng(2)
    X = rng.normal(size=(250, 8))
    y = X[:, 0] * 2 - X[:, 3] + rng.normal(size=250)
    g = _gram(X, y)
    x = [f"x{i}" for i in range(8)]
    a, l1 = 0.1, 0.7
    fit = G.fit_elastic_net(g, x, "y", a, l1)
    Xc, yc = X - X.mean(0), y - y.mean()
    grad = Xc.T @ (yc - Xc @ fit.coef) / 250 - a * (1 - l1) * fit.coef
    for j in range(8):
        if fit.coef[j] != 0:
            assert grad[j] == pytest.approx(a * l1 * np.sign(fit.coef[j]), abs=1e-8)
        else:
            assert abs(grad[j]) <= a * l1 + 1e-8


def test_fold_grams_equal_refit():
    rng = np.random.default_rng(3)
    X = rng.normal(size=(100, 3))
    y = X.sum(1) + rng.normal(size=100)
    folds = [_gram(X[i::4], y[i::4]) for i in range(4)]
    total = G.sum_grams(folds, folds[0].names)
    train = total - folds[0]
    direct = _gram(np.vstack([X[i::4] for i in (1, 2, 3)]), np.concatenate([y[i::4] for i in (1, 2, 3)]))
    assert np.allclose(train.U, direct.U)


def test_gram_by_key_on_spark(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 500).astype(str), "a": rng.normal(size=500), "b": rng.normal(size=500)})
    grams = G.gram_by_key(spark.createDataFrame(pdf).repartition(7), ["a", "b"], "k")
    for k, g in grams.items():
        sub = pdf[pdf["k"] == k]
        u = np.hstack([np.ones((len(sub), 1)), sub[["a", "b"]].to_numpy()])
        assert np.allclose(g.U, u.T @ u)


def test_sql_text_projections_equal_column_expressions(spark):
    """Prediction / indicator / filled columns built from SQL text give the
    same values as the equivalent Column expressions (quoting, literals)."""
    from pyspark.sql import functions as F
    names = ["plain", "with space", "odd`tick", "dash-name"]
    rows = [(1.5, None, 3, "a'b"), (-2.0, 4.25, None, "c\\d"), (1e16, -1e-300, 7, None), (0.1, 0.2, 0, "x")]
    df = spark.createDataFrame(rows, "plain double, `with space` double, `odd``tick` int, `dash-name` string")
    fit = G.LinearFit(names[:3], np.array([0.1, -1e-12, 3.0]), -0.3, 4.0, {})
    old = F.lit(-0.3)
    for c, b in zip(fit.features, fit.coef):
        old = old + F.coalesce(F.col(f"`{c.replace('`', '``')}`").cast("double"), F.lit(0.0)) * F.lit(float(b))
    got = df.select(
        fit.predict_expr().alias("new"), old.alias("old"),
        *[G.filled(c, f"f{i}") for i, c in enumerate(names[:3])],
        G.indicator("dash-name", "a'b").alias("i1"), G.indicator("dash-name", "c\\d").alias("i2"),
        G.indicator("odd`tick", 7).alias("i3"), (F.col("`dash-name`") == F.lit("a'b")).cast("double").alias("j1"),
        (F.col("`dash-name`") == F.lit("c\\d")).cast("double").alias("j2"),
    ).collect()
    for r in got:
        assert r["new"] == r["old"]
        assert r["i1"] == r["j1"] and r["i2"] == r["j2"]
    assert [r["i3"] for r in got] == [0.0, None, 1.0, 0.0]
    assert [r["f1"] for r in got] == [0.0, 4.25, -1e-300, 0.2]
    assert [r["f0"] for r in got] == [1.5, -2.0, 1e16, 0.1]
