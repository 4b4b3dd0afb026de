"""Title vectors against numpy's SVD, exact leave-one-out against refits, the prediction table."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riselens.operators import gram as G
from riselens.operators import textvec as TV
from riselens.operators.encoder import buckets_of, encode, fit_encoder


def titles(seed, n):
    """Titles of a few themes, so that the leading singular values stand apart."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        theme = rng.choice(6, p=[0.3, 0.25, 0.18, 0.12, 0.09, 0.06])
        out.append(" ".join(f"w{theme}x{rng.integers(0, 4)}" for _ in range(rng.integers(3, 9))))
    return out


def test_encoder_equals_svd(spark):
    some = titles(1, 300) + [None, "", "!", "one", titles(1, 1)[0]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(some)], "id long, title string").repartition(5)
    enc = fit_encoder(df, "title", dim=5, buckets=512, rounds=6)
    rows = df.select("id", buckets_of("title", 512).alias("b")).toPandas().sort_values("id")["b"]
    X = np.zeros((len(some), 512))
    for i, bs in enumerate(rows):
        for b in bs:
            X[i, b] += 1
    words = (some[0].split())
    assert X[0].sum() == 2 * len(words) - 1 and X[302].sum() == 0 and X[303].sum() == 1
    X *= np.log((1 + len(some)) / (1 + (X > 0).sum(0))) + 1
    norm = np.linalg.norm(X, axis=1, keepdims=True)
    X /= np.where(norm > 0, norm, 1)
    _, s, Vt = np.linalg.svd(X)
    assert np.allclose(enc.singular, s[:5], rtol=1e-6)
    assert np.allclose(np.abs(np.sum(enc.vectors * Vt[:5].T, axis=0)), 1, atol=1e-5)
    got = encode(df, enc).toPandas().sort_values("id")
    assert np.allclose(np.stack(got["vector"]), X @ enc.vectors, atol=1e-9)
    assert np.all(np.stack(got["vector"])[300:303] == 0) and len(got) == len(some)


def test_encoder_of_nothing(spark):
    df = spark.createDataFrame([(1, "a title")], "id long, title string")
    enc = fit_encoder(df.limit(0), "title", dim=3, buckets=64)
    assert encode(df, enc).first()["vector"] is not None and encode(df.limit(0), enc).collect() == []


def test_leave_one_out_equals_refits(spark):
    """On a standardised design and on one behind a projection; alphas between which the choice matters."""
    rng = np.random.default_rng(2)
    V = rng.normal(size=(60, 6)) * [1, 5, 0.1, 2, 1, 3] + 4
    y = V[:, 0] - 0.3 * V[:, 1] + 2 * rng.normal(size=60)
    df = spark.createDataFrame(pd.DataFrame({"vector": list(V.tolist()), "y": y})).repartition(4)
    g = TV.vector_gram(df, 6, ["y"])["all"]
    names = [f"v{i}" for i in range(6)]
    alphas = [0.01, 0.1, 1.0, 10.0, 100.0]
    mean, std = G.scaler_from_gram(g, names)
    pm, comps = TV.pca_components(g, 6, 3)
    designs = [(G.standardize(g, names, mean, std), names, np.diag(1 / std), -mean / std), (TV.project(g, 6, comps, pm), ["c0", "c1", "c2"], comps, -comps @ pm)]
    for (best, mse), (_, x, M, c) in zip(TV.ridge_loo(df, designs, "y", alphas), designs):
        Z = V @ M.T + c
        want = []
        for a in alphas:
            e = []
            for i in range(60):
                keep = np.arange(60) != i
                zm, ym = Z[keep].mean(0), y[keep].mean()
                b = np.linalg.solve((Z[keep] - zm).T @ (Z[keep] - zm) + a * np.eye(len(x)), (Z[keep] - zm).T @ (y[keep] - ym))
                e.append(y[i] - ym - (Z[i] - zm) @ b)
            want.append(np.mean(np.square(e)))
        assert np.allclose(mse, want) and best == alphas[int(np.argmin(want))]


def test_prediction_table_is_replaced_by_config(spark, tmp_path):
    df = spark.range(10).select(F.col("id").cast("string").alias("post_id"), F.lit("c").alias("subreddit"), F.lit(None).cast("timestamp").alias("created_dt"), F.col("id").alias("y"), F.lit(1.0).alias("p"))
    for config in ("a", "b", "a"):
        TV.write_predictions(df, str(tmp_path / "t"), config, "y", "p")
    rows = TV.read_predictions(spark, str(tmp_path / "t")).groupBy("config").count().collect()
    assert sorted((r["config"], r["count"]) for r in rows) == [("a", 10), ("b", 10)]


def test_pieces_cover_a_batch_and_bound_its_terms(monkeypatch):
    """What is multiplied at once is bounded by terms, and the projection does not depend on the cuts."""
    from riselens.operators import encoder
    rng = np.random.default_rng(3)
    rows = pd.Series([rng.integers(0, 64, n).tolist() for n in [0, 3, 70, 0, 9, 31, 2, 0]])
    idf, Q = rng.random(64) + 1, rng.normal(size=(64, 5))
    whole = encoder._times(rows, idf, Q)[0]
    monkeypatch.setattr(encoder, "PIECE", 16)
    pieces = list(encoder._pieces(rows))
    assert [x for p in pieces for x in p] == rows.tolist()
    assert all(sum(map(len, p.iloc[1:])) <= 16 for p in pieces) and len(pieces) > 2  # a long title may stand first
    assert np.array_equal(np.concatenate([encoder._times(p, idf, Q)[0] for p in pieces]), whole)
    assert list(encoder._pieces(rows.iloc[:0])) == []
