"""Column profile: describe figures and the most frequent value of every column."""

from riselens.operators.stats import profile


def test_profile_most_frequent_value_and_quartiles(spark):
    df = spark.createDataFrame(
        [(1, 0.5, "b", True), (2, 0.5, "a", True), (2, None, "b", False), (10, -3.0, "a", None), (None, None, None, None)],
        "n long, x double, s string, f boolean")
    out = {r["column"]: r for r in profile(df).collect()}
    assert [out["n"][c] for c in ("non_null", "missing", "unique", "top", "freq")] == [4, 1, 3, "2", 2]
    assert [out["n"][c] for c in ("p25", "p50", "p75")] == [1.75, 2.0, 4.0]
    assert abs(out["n"]["std"] - 4.193248541803041) < 1e-12 and out["n"]["missing_pct"] == 20.0
    assert (out["x"]["top"], out["x"]["freq"], out["x"]["unique"]) == ("5.000000000e-01", 2, 2)
    assert (out["s"]["top"], out["s"]["freq"], out["s"]["unique"]) == ("a", 2, 2)      # equally frequent: the smallest
    assert [out["s"][c] for c in ("min", "mean", "std", "p50")] == [None] * 4
    assert (out["f"]["top"], out["f"]["freq"], out["f"]["mean"]) == ("true", 2, 2 / 3)


def test_profile_of_text_and_empty_columns(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", None)], "s string, t string")
    out = {r["column"]: r for r in profile(df).collect()}
    assert (out["s"]["top"], out["s"]["freq"]) == ("a", 2)
    assert (out["t"]["top"], out["t"]["freq"], out["t"]["unique"], out["t"]["missing"]) == (None, None, 0, 3)
