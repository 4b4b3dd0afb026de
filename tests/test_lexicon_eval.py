"""Sentiment neighbour rules, entity n-grams and error metrics on hand-made rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riselens.operators.evaluate import error_metrics, hash_split, variant_table
from riselens.operators.lexicon import BOOSTER_INCREMENT, NEGATION_SCALAR, entity_counts, lexicon_sentiment


def test_sentiment_negation_and_booster(spark):
    posts = spark.createDataFrame([("1", "good day"), ("2", "not good"), ("3", "very good!"), ("4", ""),
                                   ("5", None), ("6", "nothing here")], "post_id string, title string")
    lex = spark.createDataFrame([("good", 2.0)], "token string, valence double")
    got = {r["post_id"]: r for r in lexicon_sentiment(posts, lex).collect()}

    def compound(s):
        return s / math.sqrt(s * s + 15)
    assert got["1"]["sentiment_compound"] == pytest.approx(compound(2.0))
    assert got["2"]["sentiment_compound"] == pytest.approx(compound(2.0 * NEGATION_SCALAR))
    assert got["3"]["sentiment_compound"] == pytest.approx(compound(2.0 + BOOSTER_INCREMENT))
    # "good day": pos share = (2+1)/(3+1)
    assert got["1"]["sentiment_positive"] == pytest.approx(3.0 / 4.0)
    assert got["1"]["sentiment_neutral"] == pytest.approx(1.0 / 4.0)
    for k in ("4", "5"):
        assert got[k]["sentiment_compound"] == 0.0 and got[k]["sentiment_neutral"] == 0.0
    assert got["6"]["sentiment_neutral"] == 1.0


def test_entity_ngrams(spark):
    posts = spark.createDataFrame([("1", "New York in May 2024"), ("2", "york")], "post_id string, title string")
    gaz = spark.createDataFrame([("new york", "ORG"), ("york", "PERSON")], "phrase string, entity_type string")
    got = {r["post_id"]: r for r in entity_counts(posts, gaz).collect()}
    assert (got["1"]["org_entities"], got["1"]["person_entities"], got["1"]["date_entities"]) == (1, 1, 2)
    assert got["1"]["total_entities"] == 4 and got["2"]["person_entities"] == 1


def test_error_metrics_match_numpy(spark):
    rng = np.random.default_rng(0)
    y, p = rng.normal(size=50), rng.normal(size=50)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double")
    r = error_metrics(df, "y", "p").collect()[0]
    assert r["rmse"] == pytest.approx(np.sqrt(np.mean((y - p) ** 2)))
    assert r["mae"] == pytest.approx(np.mean(np.abs(y - p)))
    assert r["r2"] == pytest.approx(1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2))
    v = {x["model"]: x for x in variant_table(df.withColumn("q", F.col("y") * 0.5), "y", {"a": "p", "b": "q"}, "a").collect()}
    assert v["a"]["rmse_delta_vs_baseline"] == 0.0


def test_hash_split_proportions(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("post_id"))
    counts = {r["split"]: r["count"] for r in hash_split(df).groupBy("split").count().collect()}
    assert abs(counts["train"] / 20000 - 0.70) < 0.02 and abs(counts["val"] / 20000 - 0.15) < 0.02


def test_student_p_values():
    """Closed forms for 1, 2 and 4 degrees of freedom, the integral for others, the normal limit."""
    import math

    import numpy as np

    from riselens.functions.special import incomplete_beta, student_t_two_sided
    t = np.array([1e-9, 0.01, 0.5, 1.0, 1.96, 2.5, 5.0, 12.0, 60.0])
    assert np.allclose(student_t_two_sided(t, np.ones(9)), 1 - 2 / np.pi * np.arctan(t), rtol=1e-10, atol=1e-12)
    assert np.allclose(student_t_two_sided(t, np.full(9, 2.0)), 1 - t / np.sqrt(2 + t * t), rtol=1e-8, atol=1e-12)
    s = t / np.sqrt(4 + t * t)
    assert np.allclose(student_t_two_sided(t, np.full(9, 4.0)), 1 - s * (1 + 0.5 * (1 - s * s)), rtol=1e-6, atol=1e-12)
    for v in (3, 10, 30, 100, 999, 10_000, 1_000_000):
        for x in (0.05, 0.7, 1.96, 3.3, 6.0):
            a = math.atan(x / math.sqrt(v))
            i = np.arange(200_001)
            w = np.where((i == 0) | (i == 200_000), 1, np.where(i % 2 == 1, 4, 2))
            area = a / 600_000 * np.sum(w * np.cos(a * i / 200_000) ** (v - 1))
            want = 1 - 2 / math.sqrt(math.pi) * math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) * area
            assert abs(student_t_two_sided(np.array([x]), np.array([float(v)]))[0] - want) < 1e-8, (v, x)
    assert abs(student_t_two_sided(np.array([1.959963984540054]), np.array([1e6]))[0] - 0.05) < 1e-6
    # published table: two-sided 5 % points
    for v, point in ((1, 12.706), (2, 4.303), (5, 2.571), (10, 2.228), (30, 2.042), (120, 1.980)):
        assert abs(student_t_two_sided(np.array([point]), np.array([float(v)]))[0] - 0.05) < 5e-5
    assert np.isnan(student_t_two_sided(np.array([np.nan, 1.0]), np.array([5.0, 0.0]))).all()
    assert np.allclose(incomplete_beta(2.0, 3.0, np.array([0.0, 0.5, 1.0])), [0.0, 0.6875, 1.0], rtol=1e-14)


def test_paired_t_row(spark):
    import numpy as np

    from riselens.functions.special import student_t_two_sided
    from riselens.operators.evaluate import paired_t
    rng = np.random.default_rng(3)
    y, a, b = rng.normal(size=(3, 50))
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(y, a, b)], "y double, a double, b double")
    r = paired_t(df, "y", "a", "b").first()
    d = (y - a) - (y - b)
    t = d.mean() / (d.std(ddof=1) / np.sqrt(50))
    assert r["n"] == 50 and abs(r["t_stat"] - t) < 1e-9 and abs(r["p_value"] - student_t_two_sided(np.array([t]), np.array([49.0]))[0]) < 1e-12
    for few in (df.limit(0), df.limit(1), df.selectExpr("y", "y AS a", "y AS b")):
        r = paired_t(few, "y", "a", "b").first()
        assert r["t_stat"] is None and r["p_value"] is None
