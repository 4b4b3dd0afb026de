"""Aggregations and report tables (A4–A24) and order/sample operators.

All are ``groupBy`` / ``GROUPING SETS`` aggregates with built-in functions.
Exact quantiles (linear interpolation, like pandas) come from a distributed
selection (``order.quantile_table``), never from a per-group value buffer or a
sort of the rows; ``exact=False`` switches to sketches.
"""

from __future__ import annotations

import uuid

import math
import statistics
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _q(v: Column, q: float | Sequence[float], exact: bool) -> Column:
    """Approximate quantile sketch (partial aggregation); exact quantiles go
    through ``order.group_quantiles`` instead of a per-group value buffer."""
    if exact:
        raise ValueError("exact quantiles use order.group_quantiles")
    return F.percentile_approx(v, list(q) if not isinstance(q, float) else q, 10000)


def adjusted_skew(v: Column) -> Column:
    """Bias-adjusted sample skewness G1 (pandas ``.skew()``), null below 3 rows."""
    n = F.count(v).cast("double")
    g1 = F.skewness(v)
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def community_lift(df: DataFrame, community: str = "subreddit", residual: str = "R",
                   min_posts: int = 200, exact: bool = True) -> DataFrame:
    """Per-community residual distribution, min-sample filter, lift margin."""
    r = F.col(residual).cast("double")
    src = df.filter(r.isNotNull())
    agg = src.groupBy(community).agg(
        F.count(r).alias("posts"),
        F.avg(r).alias("mean_residual"),
        *([] if exact else [_q(r, [0.5, 0.9, 0.1], False).alias("_q")]),
        F.stddev_samp(r).alias("std_residual"),
        F.avg((r > 0).cast("double")).alias("positive_share"),
        F.avg(F.abs(r)).alias("mean_abs_residual"),
    )
    if exact:
        # Exact quantiles by selection: a hot community is never one buffer.
        from riselens.operators.order import group_quantiles
        q = group_quantiles(src, [community], residual, [0.5, 0.9, 0.1])
        agg = agg.join(q, community, "left").withColumn("_q", F.array("q0", "q1", "q2")).drop("q0", "q1", "q2")
    return (
        agg.filter(F.col("posts") >= min_posts)
        .select(
            community, "posts", "mean_residual",
            F.col("_q")[0].cast("double").alias("median_residual"),
            "std_residual", "positive_share", "mean_abs_residual",
            F.col("_q")[1].cast("double").alias("residual_90p"),
            F.col("_q")[2].cast("double").alias("residual_10p"),
            (F.col("_q")[1] - F.col("_q")[2]).cast("double").alias("residual_iqr"),
            (F.col("positive_share") - F.lit(0.5)).alias("lift_margin"),
        )
    )


def residual_summary(df: DataFrame, col: str = "stage_a_residual") -> DataFrame:
    """Mean, std (ddof 1), bias-adjusted skew."""
    v = F.col(col).cast("double")
    return df.agg(
        F.avg(v).alias("residual_mean"),
        F.stddev_samp(v).alias("residual_std"),
        adjusted_skew(v).alias("residual_skew"),
    )


def fill_global(df: DataFrame, col: str, stat: str = "mean", out: str | None = None) -> DataFrame:
    """A4: fill nulls of ``col`` with its global mean / median.

    The scalar is a one-row aggregate joined to every row (broadcast of one
    row: bounded).
    """
    v = F.col(col).cast("double")
    if stat == "mean":
        one = df.agg(F.avg(v).alias("_fill"))
    else:
        from riselens.operators.order import exact_quantiles
        med = exact_quantiles(df, col, [0.5])[0]
        one = df.sparkSession.range(1).select(F.lit(med).cast("double").alias("_fill"))
    return df.crossJoin(F.broadcast(one)).withColumn(out or col, F.coalesce(v, F.col("_fill"))).drop("_fill")


def calibration(df: DataFrame, residual: str = "stage_a_residual", keys: Sequence[str] = ("hour_of_day", "subreddit")) -> DataFrame:
    """A5: mean residual by each key, all keys in one pass (GROUPING SETS)."""
    r = F.col(residual).cast("double")
    sets = ", ".join(f"({k})" for k in keys)
    v = df.select(*keys, r.alias("_r"))
    view = f"_calib_src_{uuid.uuid4().hex}"
    v.createOrReplaceTempView(view)
    key_name = " ".join(f"WHEN grouping({k}) = 0 THEN '{k}'" for k in keys)
    key_val = " ".join(f"WHEN grouping({k}) = 0 THEN CAST({k} AS STRING)" for k in keys)
    q = f"""SELECT CASE {key_name} END AS dimension, CASE {key_val} END AS level,
                   avg(_r) AS mean_residual, count(_r) AS n
            FROM {view} GROUP BY GROUPING SETS ({sets})"""
    out = df.sparkSession.sql(q)
    return out.filter(F.col("level").isNotNull() & F.col("mean_residual").isNotNull())


def lift_by(df: DataFrame, keys: Sequence[str] = ("subreddit", "hour_of_day"), actual: str = "stage_a_residual",
            pred: str = "stage_b_pred") -> DataFrame:
    """Actual mean, predicted mean and count per key group."""
    return df.filter(F.coalesce(*[F.col(k).isNotNull() for k in keys])).groupBy(*keys).agg(
        F.avg(F.col(actual).cast("double")).alias("actual_mean"),
        F.avg(F.col(pred).cast("double")).alias("pred_mean"),
        F.count(F.lit(1)).cast("double").alias("count"),
    )


def residual_table(df: DataFrame, key: str, cols: Sequence[str], z: float = 1.96) -> DataFrame:
    """Mean, std, count of residual columns by key, with a z band."""
    aggs = []
    for c in cols:
        v = F.col(c).cast("double")
        aggs += [F.avg(v).alias(f"{c}_mean"), F.stddev_samp(v).alias(f"{c}_std"), F.count(v).alias(f"{c}_count")]
    out = df.groupBy(key).agg(*aggs)
    bands = {}
    for c in cols:
        half = F.lit(z) * F.col(f"{c}_std") / F.sqrt(F.col(f"{c}_count").cast("double"))
        bands[f"{c}_lo"] = F.col(f"{c}_mean") - half
        bands[f"{c}_hi"] = F.col(f"{c}_mean") + half
    return out.withColumns(bands)


def min_volume(df: DataFrame, key: str, n: int) -> DataFrame:
    """Keep rows whose key has at least ``n`` rows (count + semi join)."""
    keep = df.groupBy(key).count().filter(F.col("count") >= n).select(key)
    return df.join(keep, key, "left_semi")


def temporal_pattern(df: DataFrame, ts: str, value: str = "score") -> DataFrame:
    """Counts and mean value by hour and by weekday (one GROUPING SETS pass)."""
    t = F.col(ts)
    base = df.select(F.hour(t).alias("hour"), F.weekday(t).alias("weekday"), F.col(value).cast("double").alias("_v"))
    g = base.groupingSets([["hour"], ["weekday"]], "hour", "weekday").agg(
        F.count(F.lit(1)).alias("posts"), F.avg("_v").alias("mean_value"))
    return g.select(F.when(F.col("hour").isNotNull(), F.lit("hour")).otherwise(F.lit("weekday")).alias("dimension"),
                    F.coalesce(F.col("hour"), F.col("weekday")).alias("level"), "posts", "mean_value")


def flag_effect(df: DataFrame, flags: Sequence[str], value: str = "score") -> DataFrame:
    """Mean value by each binary flag (unpivot, then one groupBy)."""
    stacked = df.select(
        F.col(value).cast("double").alias("_v"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).cast("int").alias("flag_value")) for f in flags])).alias("s"),
    )
    return stacked.groupBy("s.flag", "s.flag_value").agg(F.count(F.lit(1)).alias("posts"), F.avg("_v").alias("mean_value"))


def compare_platforms(df: DataFrame, platform: str = "platform") -> DataFrame:
    """Per platform count, mean/median score, mean title length, mean comments."""
    from riselens.operators.order import group_quantiles
    agg = df.groupBy(platform).agg(
        F.count(F.lit(1)).alias("posts"),
        F.avg(F.col("score").cast("double")).alias("mean_score"),
        F.avg(F.length(F.coalesce(F.col("title"), F.lit(""))).cast("double")).alias("mean_title_length"),
        F.avg(F.col("comment_count").cast("double")).alias("mean_comments"),
    )
    med = group_quantiles(df, [platform], "score", [0.5]).withColumnRenamed("q0", "median_score")
    return agg.join(med, platform, "left")


def ladder_audit(df: DataFrame, ladder: Sequence[str] = ("score_5m", "score_15m", "score_30m", "score_60m"),
                 final: str = "score", edges: Sequence[float] | None = None) -> DataFrame:
    """Match rate of each rung with the final score, all-equal share, by
    right-closed score bucket (W10)."""
    fin = F.col(final).cast("double")
    eq = {c: F.coalesce(F.col(c).cast("double") == fin, F.lit(False)) for c in ladder}
    all_eq = F.lit(True)
    for e in eq.values():
        all_eq = all_eq & e
    edges = list(edges) if edges is not None else [0, 1, 5, 10, 25, 50, 100, 250, 500, 1000]
    bucket = bin_right_closed(fin, edges)
    base = df.select(bucket.alias("score_bucket"), all_eq.cast("double").alias("all_equal"),
                     *[e.cast("double").alias(f"{c}_equal") for c, e in eq.items()])
    return base.groupBy("score_bucket").agg(
        F.count(F.lit(1)).alias("bucket_rows"),
        F.avg("all_equal").alias("share_all_equal"),
        *[F.avg(f"{c}_equal").alias(f"share_{c}_equal") for c in ladder],
    )


def bin_right_closed(v: Column, edges: Sequence[float]) -> Column:
    """Label of the (lo, hi] bin; the first bin includes its lower edge;
    values above the last edge go to '>last'."""
    expr = None
    for i in range(len(edges) - 1):
        lo, hi = edges[i], edges[i + 1]
        cond = (v >= lo) & (v <= hi) if i == 0 else (v > lo) & (v <= hi)
        label = F.lit(f"[{lo:g}, {hi:g}]" if i == 0 else f"({lo:g}, {hi:g}]")
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.when(v > edges[-1], F.lit(f">{edges[-1]:g}"))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlations of all pairs in one aggregate, long form."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    stacked = row.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"{i}").alias("corr")) for i, (a, b) in enumerate(pairs)
    ])).alias("s"))
    return stacked.select("s.*")


def trimmed(df: DataFrame, metric: str, value: str, frac: float = 0.1) -> DataFrame:
    """Per group, drop floor(n*frac) values at each tail; mean and std.

    The values at both cuts are selected (no ranks of all rows); what lies
    between them is summed around the lower one, of which copies add nothing,
    with as many copies of the upper one as stay.
    """
    from riselens.operators.order import MOST_CELLS, select_ranks
    from riselens.session import checkpoint
    v = F.col(value).cast("double")
    base = df.select(F.col(metric).alias("_m"), v.alias("_v")).where("_v IS NOT NULL")
    cut = lambda n: F.floor(n * F.lit(frac)).cast("long")
    found = select_ranks(base, ["_m"], ["_v"], lambda n: [F.least(cut(n), n - 1), F.greatest(n - 1 - cut(n), F.lit(0).cast("long"))])
    n, k = F.col("n"), cut(F.col("n"))
    cuts = found.select(F.col("_m").alias("_g"), "n", k.alias("k"), F.element_at("at", F.least(k, n - 1)).alias("a"),
                        F.element_at("at", F.greatest(n - 1 - k, F.lit(0).cast("long"))).alias("b"))
    cuts = checkpoint(cuts)
    small = cuts.limit(MOST_CELLS + 1).count() <= MOST_CELLS
    j = base.join(F.broadcast(cuts) if small else cuts, F.col("_m").eqNullSafe(F.col("_g")))
    inner = F.when((F.col("_v") > F.col("a")) & (F.col("_v") < F.col("b")), F.col("_v") - F.col("a"))
    sums = j.groupBy("_m", "n", "k", "a", "b").agg(
        F.count(inner).alias("c"), F.coalesce(F.sum(inner), F.lit(0.0)).alias("s1"), F.coalesce(F.sum(inner * inner), F.lit(0.0)).alias("s2"),
        F.count_if(F.col("_v") < F.col("b")).alias("below"))
    kept = F.col("n") - 2 * F.col("k")
    high = F.when(F.col("a") == F.col("b"), F.lit(0)).otherwise(F.col("n") - F.col("k") - F.col("below"))
    width = F.col("b") - F.col("a")
    t1, t2 = F.col("s1") + high * width, F.col("s2") + high * width * width
    mean = t1 / kept
    std = F.when(kept > 1, F.sqrt(F.greatest((t2 - t1 * mean) / (kept - 1), F.lit(0.0))))
    return sums.where(kept > 0).select(F.col("_m").alias(metric), (F.col("a") + mean).alias("mean"), std.alias("std"), kept.alias("n"))


def best_row(df: DataFrame, metric: str, mode: str = "max", tie: str | None = None) -> DataFrame:
    """The row with the best metric (idxmax / idxmin), as one aggregate."""
    row = F.struct(*[F.col(c) for c in df.columns])
    order = F.struct(F.col(metric), F.col(tie)) if tie else F.col(metric)
    pick = F.max_by(row, order) if mode == "max" else F.min_by(row, order)
    return df.agg(pick.alias("_b")).select("_b.*")


def histogram(df: DataFrame, col: str, bins: int = 30, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Equal-width histogram with ``width_bucket`` (range from data if unset)."""
    v = F.col(col).cast("double")
    if lo is None or hi is None:
        rng = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
        j = df.select(v.alias("_v")).crossJoin(F.broadcast(rng))
    else:
        j = df.select(v.alias("_v"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))
    b = F.least(F.width_bucket(F.col("_v"), F.col("lo"), F.col("hi") + F.lit(1e-12), F.lit(bins)), F.lit(bins))
    return j.filter(F.col("_v").isNotNull()).groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.min("lo").alias("range_lo"), F.max("hi").alias("range_hi"))


def qq_table(df: DataFrame, col: str, k: int = 99) -> DataFrame:
    """Empirical quantiles against standard-normal quantiles (QQ data);
    exact quantiles from one selection."""
    from riselens.operators.order import exact_quantiles
    probs = [(i + 0.5) / k for i in range(k)]
    nd = statistics.NormalDist()
    qs = exact_quantiles(df, col, probs)
    rows = [(i, p, nd.inv_cdf(p), q) for i, (p, q) in enumerate(zip(probs, qs))]
    return df.sparkSession.createDataFrame(rows, "i int, prob double, normal_quantile double, sample_quantile double")


def describe(df: DataFrame, cols: Sequence[str], percentiles: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Count, mean, std, min, percentiles, max for numeric columns, long
    form.  Moments in one aggregate; exact percentiles of all columns by one selection."""
    from riselens.operators.order import quantile_table
    aggs = []
    for c in cols:
        v = F.col(c).cast("double")
        aggs += [F.count(v).alias(f"{c}__n"), F.avg(v).alias(f"{c}__m"), F.stddev_samp(v).alias(f"{c}__s"),
                 F.min(v).alias(f"{c}__lo"), F.max(v).alias(f"{c}__hi")]
    row = df.agg(*aggs).collect()[0]
    found = {r["column"]: [r[f"q{i}"] for i in range(len(percentiles))] for r in quantile_table(df, [], cols, percentiles).collect()}
    out = [(c, row[f"{c}__n"], row[f"{c}__m"], row[f"{c}__s"], row[f"{c}__lo"], *found.get(c, [None] * len(percentiles)), row[f"{c}__hi"]) for c in cols]
    pcols = ", ".join(f"p{int(round(p * 100))} double" for p in percentiles)
    return df.sparkSession.createDataFrame(out, f"column string, count long, mean double, std double, min double, {pcols}, max double")


def quality_report(df: DataFrame, key: str = "post_id", value: str = "score", z: float = 3.0) -> DataFrame:
    """Null counts per column, duplicate ids, outliers beyond z std."""
    v = F.col(value).cast("double")
    stats = df.agg(F.avg(v).alias("_m"), F.stddev_samp(v).alias("_s"))
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns]
    base = df.crossJoin(F.broadcast(stats))
    return base.agg(
        F.count(F.lit(1)).alias("rows"),
        (F.count(F.lit(1)) - F.count_distinct(F.col(key))).alias("duplicate_ids"),
        F.count_if(F.abs(v - F.col("_m")) > F.lit(z) * F.col("_s")).alias("outliers"),
        *nulls,
    )


def profile(df: DataFrame) -> DataFrame:
    """Per-column type, non-null/missing counts, distinct count,
    numeric min/max/mean/std and exact quartiles, and the most frequent value
    (as text, the smallest of equally frequent ones) with its frequency.

    The values of all columns are counted by one GROUPING SETS pass, a set for
    each column, which gives the distinct count and the most frequent value."""
    from riselens.operators.order import quantile_table
    dtypes = dict(df.dtypes)
    numeric = {"int", "bigint", "double", "float", "smallint", "tinyint", "boolean"}
    aggs, tops = [], []
    for i, (c, t) in enumerate(dtypes.items()):
        col, v = F.col(c), F.col(f"_v{i}")
        num = col.cast("double") if t in numeric else F.lit(None).cast("double")
        aggs.append(F.struct(
            F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.count(col).alias("non_null"),
            F.count_if(col.isNull()).alias("missing"),
            F.min(num).alias("min"), F.max(num).alias("max"), F.avg(num).alias("mean"), F.stddev_samp(num).alias("std"),
        ).alias(c))
        top = F.min_by(v, F.when(v.isNotNull(), F.struct((-F.col("_n")).alias("n"), v)))
        tops.append(F.struct(
            F.lit(c).alias("_c"), F.count(v).alias("unique"),
            (F.format_string("%.9e", top.cast("double")) if t in ("double", "float") else top.cast("string")).alias("top"),
            F.max(F.when(v.isNotNull(), F.col("_n"))).alias("freq"),
        ).alias(f"_v{i}"))
    values = [f"_v{i}" for i in range(len(dtypes))]
    counted = df.select(*[F.col(c).alias(v) for c, v in zip(dtypes, values)]).groupingSets(
        [[v] for v in values], *values).agg(F.count(F.lit(1)).alias("_n"))

    def long(row: DataFrame, cols: Sequence[str]) -> DataFrame:
        return row.select(F.explode(F.array(*[F.col(c) for c in cols])).alias("s")).select("s.*")

    out = long(df.agg(*aggs), list(dtypes)).join(F.broadcast(long(counted.agg(*tops), values)), F.col("column") == F.col("_c")).drop("_c")
    numbers = [c for c, t in dtypes.items() if t in numeric]
    quartiles = [F.lit(None).cast("double").alias(q) for q in ("p25", "p50", "p75")]
    if numbers:
        found = quantile_table(df, [], numbers, [0.25, 0.5, 0.75])
        out = out.join(F.broadcast(found.withColumnRenamed("column", "_c").drop("n")), F.col("column") == F.col("_c"), "left")
        quartiles = [F.col(f"q{i}").alias(q) for i, q in enumerate(("p25", "p50", "p75"))]
    pct = F.col("missing") * 100.0 / (F.col("missing") + F.col("non_null"))
    return out.select("column", "dtype", "non_null", "missing", "unique", "min", "max", "mean", pct.alias("missing_pct"),
                      "std", *quartiles, "top", "freq")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Value counts with share."""
    total = df.agg(F.count(F.lit(1)).alias("_t"))
    return df.groupBy(col).count().crossJoin(F.broadcast(total)).withColumn(
        "share", F.col("count") / F.col("_t")).drop("_t")


# ---------------------------------------------------------------------------
# Order, split and sample operators
# ---------------------------------------------------------------------------

def split_time(df: DataFrame, ts: str = "created_timestamp", q: float = 0.7) -> float:
    """The exact linear-interpolated q-quantile of the time column."""
    from riselens.operators.order import exact_quantiles
    return exact_quantiles(df, ts, [q])[0]


def time_split(df: DataFrame, ts: str = "created_timestamp", q: float = 0.7) -> DataFrame:
    """Label rows 'train' (ts <= quantile) or 'test'."""
    t = split_time(df, ts, q)
    return df.withColumn("split_time", F.lit(t)).withColumn(
        "split", F.when(F.col(ts).cast("double") <= F.lit(t), F.lit("train")).otherwise(F.lit("test")))


def expanding_blocks(df: DataFrame, ts: str) -> DataFrame:
    """Per day its rows and the rows of all earlier days (rows without a time go).

    The running sum is over one row per day.
    """
    days = df.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("test_count"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return days.withColumn("train_count", F.coalesce(F.sum("test_count").over(before), F.lit(0)))


def head_fraction(df: DataFrame, ts: str, f: float, tie: str = "post_id") -> DataFrame:
    """The first floor(n*f) rows in time order (distributed global rank)."""
    from riselens.operators.order import global_rank
    ranked = global_rank(df, [ts, tie], "_rank")
    n = ranked.count()
    return ranked.filter(F.col("_rank") < F.lit(int(n * f))).drop("_rank")


def top_k(df: DataFrame, by: str | Sequence[str], k: int, ascending: bool | Sequence[bool] = False,
          tie: str | None = None) -> DataFrame:
    """Ordered top-k (TakeOrderedAndProject) with a tie-break."""
    bys = [by] if isinstance(by, str) else list(by)
    ascs = [ascending] * len(bys) if isinstance(ascending, bool) else list(ascending)
    order = [F.col(b).asc_nulls_last() if a else F.col(b).desc_nulls_last() for b, a in zip(bys, ascs)]
    if tie:
        order.append(F.col(tie).asc())
    return df.orderBy(*order).limit(k)


def cap_per_group(df: DataFrame, keys: Sequence[str], n: int = 30, seed: int = 42, id_col: str = "post_id",
                  target: int = 50_000) -> DataFrame:
    """At most ``n`` rows per group, chosen by a seeded hash order.

    A group is split into ceil(size/target) hash sub-groups (sizes from a
    partial count), the best ``n`` of every sub-group survive a window over
    that bounded sub-group, and the survivors (<= n per sub-group) are ranked
    per group.  Same rows as ranking the whole group at once.
    """
    keys = list(keys)
    h = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt"))
    from riselens.operators.joins import attach_small
    d = attach_small(df, sizes, keys, "left")
    subs = F.greatest(F.lit(1), F.ceil(F.col("_cnt") / F.lit(target)))
    salted = d.withColumn("_h", h).withColumn("_salt", F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), subs))
    w1 = Window.partitionBy(*keys, "_salt").orderBy("_h", id_col)
    pre = salted.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= n)
    w2 = Window.partitionBy(*keys).orderBy("_h", id_col)
    return pre.withColumn("_r", F.row_number().over(w2)).filter(F.col("_r") <= n).drop(
        "_h", "_salt", "_r1", "_r", "_cnt")


def sample_n(df: DataFrame, n: int, seed: int = 42, id_col: str = "post_id") -> DataFrame:
    """Bounded hash-ordered sample of ``n`` rows (deterministic)."""
    h = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))
    return df.withColumn("_h", h).orderBy("_h", id_col).limit(n).drop("_h")


def rank_results(df: DataFrame, metric: str, index: str = "index") -> DataFrame:
    """Stable rank by metric descending (nulls last), ties by index.

    A results table has one row per configuration: a global window is fine.
    """
    w = Window.orderBy(F.col(metric).desc_nulls_last(), F.col(index).asc())
    return df.withColumn("rank", F.row_number().over(w))
