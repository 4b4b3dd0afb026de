import itertools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from riselens.operators.pairwise import _count_block, concordance_counts, pairwise_accuracy


def brute(a, p):
    c = d = 0
    for i, j in itertools.combinations(range(len(a)), 2):
        da, dp = a[i] - a[j], p[i] - p[j]
        if da == 0 or dp == 0:
            continue
        if da * dp > 0:
            c += 1
        else:
            d += 1
    return c, d


def test_count_block_matches_brute_force():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 5, 37, 200):
        a = rng.integers(0, 7, n).astype(float)
        p = rng.integers(0, 9, n).astype(float)
        # collapse to weighted distinct points like the Spark side does
        df = pd.DataFrame({"a": a, "p": p}).value_counts().reset_index(name="w")
        c, d = _count_block(df["a"].to_numpy(), df["p"].to_numpy(), df["w"].to_numpy(float))
        assert (round(c), round(d)) == brute(a, p)


def test_recursive_split_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for blk, n in (("hot", 400), ("mid", 60), ("tiny", 3), ("one", 1)):
        for _ in range(n):
            rows.append((blk, float(rng.integers(0, 40)), float(rng.integers(0, 25))))
    pdf = pd.DataFrame(rows, columns=["blk", "a", "p"])
    df = spark.createDataFrame(pdf)
    # max_group far below the hot block forces two levels of splitting
    out = concordance_counts(df, ["blk"], "a", "p", by=["blk"], max_group=20, fanout=4, max_depth=4)
    got = {r["blk"]: (r["concordant"], r["discordant"]) for r in out.collect()}
    for blk, g in pdf.groupby("blk"):
        exp = brute(g["a"].to_numpy(), g["p"].to_numpy())
        assert got.get(blk, (0, 0)) == exp, blk


def test_pairwise_accuracy_no_pairs_is_null(spark):
    df = spark.createDataFrame([("x", 1.0, 1.0), ("y", 2.0, 3.0)], "blk string, a double, p double")
    r = pairwise_accuracy(df, ["blk"], "a", "p").collect()[0]
    assert r["pairs"] == 0 and r["pairwise_accuracy"] is None
