"""Distributed rank and exact quantiles vs numpy, on a skewed key."""

import numpy as np
import pandas as pd
import pytest

from riselens.operators.order import exact_quantiles, global_rank, group_quantiles
from riselens.operators.stats import cap_per_group, trimmed


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    keys = np.where(rng.random(3000) < 0.6, "hot", rng.choice(["a", "b", "c"], 3000))   # 60% one key
    pdf = pd.DataFrame({"id": np.arange(3000).astype(str), "k": keys, "v": rng.normal(size=3000).round(3)})
    return pdf, spark.createDataFrame(pdf).repartition(13)


def test_global_rank_is_a_total_order(skewed):
    pdf, df = skewed
    r = global_rank(df, ["v", "id"], "rk").toPandas()
    exp = pdf.sort_values(["v", "id"]).reset_index(drop=True)
    got = r.sort_values("rk").reset_index(drop=True)
    assert list(got["rk"]) == list(range(3000))
    assert list(got["id"]) == list(exp["id"])


def test_exact_quantiles_match_numpy(skewed):
    pdf, df = skewed
    probs = [0.0, 0.1, 0.5, 0.7, 0.99, 1.0]
    got = exact_quantiles(df, "v", probs)
    assert np.allclose(got, np.quantile(pdf["v"], probs))


def test_group_quantiles_match_pandas(skewed):
    pdf, df = skewed
    got = group_quantiles(df, ["k"], "v", [0.5, 0.9]).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        assert got.loc[k, "q0"] == pytest.approx(g["v"].quantile(0.5))
        assert got.loc[k, "q1"] == pytest.approx(g["v"].quantile(0.9))


def test_trimmed_matches_pandas(skewed):
    pdf, df = skewed
    got = trimmed(df, "k", "v", 0.1).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        s = np.sort(g["v"].to_numpy())
        cut = int(len(s) * 0.1)
        kept = s[cut:len(s) - cut]
        assert got.loc[k, "mean"] == pytest.approx(kept.mean())
        assert got.loc[k, "n"] == len(kept)


def test_cap_per_group_same_as_whole_group_ranking(skewed, spark):
    import hashlib
    pdf, df = skewed
    got = cap_per_group(df, ["k"], n=7, seed=42, id_col="id", target=100).toPandas()   # forces sub-groups
    for k, g in pdf.groupby("k"):
        h = g["id"].map(lambda i: hashlib.md5(f"{i}|42".encode()).hexdigest())
        exp = set(g.assign(h=h).sort_values(["h", "id"]).head(7)["id"])
        assert set(got[got["k"] == k]["id"]) == exp


def test_bucket_tree_equals_bisect(spark):
    import bisect
    from pyspark.sql import functions as F
    from riselens.plans.diagnostics import bucket_of
    cuts = sorted({3, 7, 8, 20, 21, 50, 99, 100, 101, 150})
    rows = spark.range(0, 200).withColumn("b", bucket_of(F.col("id"), cuts)).collect()
    assert all(r["b"] == bisect.bisect_right(cuts, r["id"]) for r in rows)


def test_quantiles_of_ranked_equal_exact(skewed):
    from riselens.operators.order import quantiles_of_ranked
    pdf, df = skewed
    ranked = global_rank(df, ["v", "id"], "rk")
    probs = [0.0, 0.25, 0.7, 1.0]
    assert np.allclose(quantiles_of_ranked(ranked, "rk", "v", len(pdf), probs), np.quantile(pdf["v"], probs))


@pytest.fixture(scope="module")
def awkward(spark):
    """60 % of rows on one (key, value), signs, zeros, infinities, NaN, nulls, null keys, neighbours of powers of two."""
    rng = np.random.default_rng(11)
    n = 4000
    v = rng.choice([0.0, -0.0, 8.0, np.nextafter(8, 0), np.nextafter(8, 9), -1.5, 1e-300, -1e300, 5e-324, 3.0], n)
    v = np.where(rng.random(n) < 0.4, rng.normal(size=n) * 10.0 ** rng.integers(-8, 9, n), v)
    k = rng.choice(["a", "b", None], n)
    hot = rng.random(n) < 0.6
    k, v = np.where(hot, "hot", k), np.where(hot, 7.25, v)
    rows = [(kk, None if i % 97 == 0 else float(x), float(i % 5)) for i, (kk, x) in enumerate(zip(k, v))]
    rows += [("none", None, None), ("one", 4.0, None)]
    return rows, spark.createDataFrame(rows, "k string, v double, w double").repartition(9)


def _expected(rows, at, probs):
    out = {}
    for key in {r[0] for r in rows}:
        x = np.array([r[at] for r in rows if r[0] == key and r[at] is not None])
        if len(x):
            out[key] = np.quantile(x, probs)
    return out


@pytest.mark.parametrize("open_values, cells", [(100_000, 200_000), (3, 0)])
def test_selection_equals_numpy(awkward, monkeypatch, open_values, cells):
    """Also with cells divided down to a few values, and with more cells than are broadcast."""
    from riselens.operators import order
    monkeypatch.setattr(order, "OPEN_VALUES", open_values)
    monkeypatch.setattr(order, "MOST_CELLS", cells)
    monkeypatch.setattr(order, "SPLIT", 1024 if cells else 4)
    rows, df = awkward
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 0.9, 1.0]
    got = order.quantile_table(df, ["k"], ["v", "w"], probs).collect()
    for at, c in ((1, "v"), (2, "w")):
        want = _expected(rows, at, probs)
        own = {r["k"]: [r[f"q{i}"] for i in range(len(probs))] for r in got if r["column"] == c}
        assert own.keys() == want.keys()
        for key in want:
            assert np.allclose(own[key], want[key], rtol=1e-12, atol=0), (c, key)
    assert np.allclose(exact_quantiles(df, "v", probs), np.quantile([r[1] for r in rows if r[1] is not None], probs), rtol=1e-12, atol=0)


def test_selection_of_infinities_and_nothing(spark):
    from riselens.operators.order import quantile_table
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (1.0,), (float("nan"),), (None,)], "v double")
    r = quantile_table(df, [], ["v"], [0.0, 1 / 3, 2 / 3, 1.0]).first()
    assert r["n"] == 4 and (r["q0"], r["q1"], r["q2"]) == (float("-inf"), 1.0, float("inf")) or np.isnan(r["q2"])
    assert exact_quantiles(df.limit(0), "v", [0.5]) == [None]
    assert group_quantiles(df.withColumn("k", df["v"].cast("string")).where("v IS NULL"), ["k"], "v", [0.5]).collect() == []


def test_selection_reads_no_sorted_rows(awkward):
    """A hot value leaves one partial row per task: the largest shuffled partition stays small."""
    from pyspark.sql import functions as F
    from riselens.operators.order import cell_of
    rows, df = awkward
    sizes = df.where("v IS NOT NULL").groupBy("k", cell_of(F.col("v")).alias("c"), "v").count()
    assert sizes.count() < 0.6 * len(rows)
    plan = sizes._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "rangepartitioning" not in plan


@pytest.mark.parametrize("frac", [0.0, 0.1, 0.34, 0.5])
def test_trimmed_on_hot_values(awkward, frac):
    rows, df = awkward
    from pyspark.sql import functions as F
    got = {r["k"]: r for r in trimmed(df.where(F.abs("v") < 1e9), "k", "v", frac).collect()}
    for key in {r[0] for r in rows}:
        x = np.sort([r[1] for r in rows if r[0] == key and r[1] is not None and abs(r[1]) < 1e9])
        cut = int(np.floor(len(x) * frac))
        x = x[cut:len(x) - cut]
        if not len(x):
            assert key not in got
            continue
        assert got[key]["n"] == len(x)
        assert got[key]["mean"] == pytest.approx(x.mean(), rel=1e-9, abs=1e-9)
        if len(x) > 1:
            assert got[key]["std"] == pytest.approx(x.std(ddof=1), rel=1e-6, abs=1e-6)


def test_cells_divided_further_when_cells_are_broadcast(spark, monkeypatch):
    """Times of one era fall into one cell: beyond OPEN_VALUES it is joined with spans derived from itself."""
    from riselens.operators import order
    monkeypatch.setattr(order, "OPEN_VALUES", 50)
    v = 1.7e9 + np.arange(900) * 0.37
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    assert np.allclose(exact_quantiles(df, "v", [0.0, 0.1, 0.7, 1.0]), np.quantile(v, [0.0, 0.1, 0.7, 1.0]), rtol=0, atol=1e-6)
