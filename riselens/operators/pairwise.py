"""Pairwise ordering accuracy without enumerating pairs.

E2 asks, inside each block (community × hour), for the share of row pairs
whose actual and predicted differences have the same sign, skipping pairs tied
on either side.  The studied code loops over all pairs; a self-join would emit
them.  Both grow with the square of the block, and one block may hold a third
of all rows.  Here the pairs are *counted*:

* rows are first collapsed to distinct points ``(block, a, p)`` with a weight
  (partial aggregation);
* a block of at most ``max_group`` points is counted exactly in one pandas
  call with an O(m log² m) merge count (``_count_block``);
* a larger block is split by value ranges into ``fanout`` chunks of ``a`` and
  of ``p`` (approximate quantile boundaries; any boundaries are exact here,
  they only steer sizes).  Every pair with neither tie falls in exactly one
  of three smaller problems, each again a concordance count:
  (1) same a-chunk: the original points of the chunk;
  (2) different a-chunks, same p-chunk: points (a-chunk index, p);
  (3) different a-chunks and p-chunks: the grid of (a-chunk, p-chunk) cells
      with summed weights.
  Problems whose a or p is constant contribute nothing and are dropped.  The
  recursion repeats until every problem is small (a few levels even for a
  block of 10^11 rows), with lineage cut by a reliable checkpoint per level.

Counts are exact while a block has fewer than 2^53 pairs (double sums).
"""

from __future__ import annotations

import uuid

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riselens.operators.joins import attach_small
from riselens.session import checkpoint

MAX_GROUP = 50_000
FANOUT = 128
MAX_DEPTH = 6


# ---------------------------------------------------------------------------
# Exact weighted count inside one bounded block (numpy, vectorised)
# ---------------------------------------------------------------------------

def _lower_pairs(pr: np.ndarray, w: np.ndarray, gid: np.ndarray | None = None) -> np.ndarray:
    """Per group: sum of w_j * w_i over positions j < i with pr_j < pr_i.

    Rows must be ordered by group, then by the tie order.  Bottom-up merge
    levels: at each level the left halves are sorted by (merge block, group,
    rank) with cumulative weights and every right element looks up the
    weight of smaller ranks in its own block and group (vectorised).
    """
    m = len(pr)
    ng = 1 if gid is None else int(gid.max()) + 1 if m else 1
    gid = np.zeros(m, dtype=np.int64) if gid is None else gid
    out = np.zeros(ng)
    if m < 2:
        return out
    pos = np.arange(m, dtype=np.int64)
    span = np.int64(pr.max() + 2)
    size = 1
    while size < m:
        blk = pos // (2 * size)
        right = ((pos // size) % 2) == 1
        li = np.nonzero(~right)[0]
        ri = np.nonzero(right)[0]
        if len(ri):
            base_l = (blk[li] * ng + gid[li]) * span
            lk = base_l + pr[li]
            order = np.argsort(lk, kind="stable")
            lk_sorted = lk[order]
            cw = np.concatenate(([0.0], np.cumsum(w[li][order])))
            base_r = (blk[ri] * ng + gid[ri]) * span
            hi = np.searchsorted(lk_sorted, base_r + pr[ri], side="left")
            lo = np.searchsorted(lk_sorted, base_r, side="left")
            np.add.at(out, gid[ri], w[ri] * (cw[hi] - cw[lo]))
        size *= 2
    return out


def _pairs_by(w: np.ndarray, keys: list[np.ndarray], ng: int, gid: np.ndarray) -> np.ndarray:
    """Per group: weighted pairs of distinct points sharing all ``keys``."""
    df = pd.DataFrame({"g": gid, "w": w, "w2": w * w, **{f"k{i}": k for i, k in enumerate(keys)}})
    cols = ["g"] + [f"k{i}" for i in range(len(keys))]
    agg = df.groupby(cols, sort=False).agg(s=("w", "sum"), s2=("w2", "sum")).reset_index()
    out = np.zeros(ng)
    np.add.at(out, agg["g"].to_numpy(), ((agg["s"] ** 2 - agg["s2"]) / 2.0).to_numpy())
    return out


def _count_blocks(gid: np.ndarray, a: np.ndarray, p: np.ndarray, w: np.ndarray, ng: int) -> tuple[np.ndarray, np.ndarray]:
    """(concordant, discordant) weighted pairs per group id; ties skipped."""
    if len(a) == 0:
        return np.zeros(ng), np.zeros(ng)
    ar = np.unique(a, return_inverse=True)[1].astype(np.int64)
    pr = np.unique(p, return_inverse=True)[1].astype(np.int64)
    order = np.lexsort((pr, ar, gid))
    gid, ar, pr, w = gid[order], ar[order], pr[order], w[order].astype(np.float64)
    total = _pairs_by(w, [], ng, gid)
    lower = _lower_pairs(pr, w, gid)
    same_a = _pairs_by(w, [ar], ng, gid)
    same_p = _pairs_by(w, [pr], ng, gid)
    same_ap = _pairs_by(w, [ar, pr], ng, gid)
    # lower counts same-a pairs with a smaller p too; remove them (exact ties stay out)
    return lower - same_a + same_ap, total - lower - same_p


def _count_block(a: np.ndarray, p: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """(concordant, discordant) weighted pairs of one block."""
    c, d = _count_blocks(np.zeros(len(a), dtype=np.int64), a, p, w, 1)
    return float(c[0]), float(d[0])


_COUNT_SCHEMA = "rk string, concordant double, discordant double"


def _count_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """Count every block of a bucket in one vectorised call."""
    grp = pdf.groupby(["rk", "g"], sort=False)
    gid = grp.ngroup().to_numpy().astype(np.int64)
    rk = grp["rk"].first().to_numpy()
    c, d = _count_blocks(gid, pdf["a"].to_numpy(dtype=np.float64), pdf["p"].to_numpy(dtype=np.float64),
                         pdf["w"].to_numpy(dtype=np.float64), len(rk))
    out = pd.DataFrame({"rk": rk, "concordant": c, "discordant": d})
    return out.groupby("rk", as_index=False).sum()


# ---------------------------------------------------------------------------
# Distributed driver
# ---------------------------------------------------------------------------

def _chunk_index(v, bounds):
    """Number of boundaries strictly below v: ties share a chunk; monotone."""
    return F.size(F.filter(bounds, lambda b: b < v)).cast("double")


def concordance_counts(
    df: DataFrame,
    block_cols: Sequence[str],
    actual: str,
    pred: str,
    by: Sequence[str] = (),
    max_group: int = MAX_GROUP,
    fanout: int = FANOUT,
    max_depth: int = MAX_DEPTH,
) -> DataFrame:
    """Concordant / discordant pair counts per report key ``by``.

    ``by`` must be a subset of ``block_cols`` (pairs never cross blocks).
    Returns ``by..., concordant, discordant`` as longs.
    """
    by = list(by)
    rk = F.to_json(F.struct(*[F.col(c) for c in by])) if by else F.lit("{}")
    bk = F.to_json(F.struct(*[F.col(c) for c in block_cols]))
    valid = F.lit(True)
    for c in list(block_cols) + [actual, pred]:
        valid = valid & F.col(c).isNotNull()
    valid = valid & ~F.isnan(F.col(actual).cast("double")) & ~F.isnan(F.col(pred).cast("double"))
    base = df.filter(valid).select(
        rk.alias("rk"), F.concat(bk, F.lit("#")).alias("g"),
        F.col(actual).cast("double").alias("a"), F.col(pred).cast("double").alias("p"))
    pts = checkpoint(base.groupBy("rk", "g", "a", "p").agg(F.count(F.lit(1)).cast("double").alias("w")))

    parts: list[DataFrame] = []
    for depth in range(max_depth + 1):
        stats = pts.groupBy("rk", "g").agg(
            F.count(F.lit(1)).alias("n"), F.min("a").alias("a0"), F.max("a").alias("a1"),
            F.min("p").alias("p0"), F.max("p").alias("p1"))
        live = stats.filter((F.col("a0") < F.col("a1")) & (F.col("p0") < F.col("p1")))
        last = depth == max_depth
        small = live if last else live.filter(F.col("n") <= max_group)
        small_pts = pts.join(small.select("rk", "g"), ["rk", "g"], "left_semi")
        # Many small blocks per pandas call: blocks are packed into hash buckets
        # (a bucket holds about ``max_group`` points on average).
        n_buckets = max(1, int(pts.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")) * 4)
        bucket = F.pmod(F.xxhash64("rk", "g"), F.lit(n_buckets))
        parts.append(small_pts.withColumn("_b", bucket).groupBy("_b").applyInPandas(
            lambda pdf: _count_bucket(pdf), _COUNT_SCHEMA))
        if last:
            break
        big = checkpoint(live.filter(F.col("n") > max_group).select("rk", "g", "n"))
        if big.isEmpty():
            break
        big_pts = pts.join(big.select("rk", "g"), ["rk", "g"], "left_semi")
        probs = [i / fanout for i in range(1, fanout)]
        bounds = big_pts.groupBy("rk", "g").agg(
            F.array_distinct(F.percentile_approx("a", probs, 10 * fanout)).alias("ab"),
            F.array_distinct(F.percentile_approx("p", probs, 10 * fanout)).alias("pb"))
        j = attach_small(big_pts, bounds, ["rk", "g"], "inner")
        j = j.withColumns({"ac": _chunk_index(F.col("a"), F.col("ab")), "pc": _chunk_index(F.col("p"), F.col("pb"))})
        tag = F.lit(f"{depth}.")
        same_a = j.select("rk", F.concat("g", tag, F.lit("A"), F.col("ac").cast("int").cast("string"), F.lit("/")).alias("g"),
                          "a", "p", "w")
        same_p = j.select("rk", F.concat("g", tag, F.lit("P"), F.col("pc").cast("int").cast("string"), F.lit("/")).alias("g"),
                          F.col("ac").alias("a"), "p", "w")
        grid = j.select("rk", F.concat("g", tag, F.lit("G/")).alias("g"), F.col("ac").alias("a"), F.col("pc").alias("p"), "w")
        pts = checkpoint(same_a.unionByName(same_p).unionByName(grid)
                         .groupBy("rk", "g", "a", "p").agg(F.sum("w").alias("w")))

    counts = parts[0]
    for extra in parts[1:]:
        counts = counts.unionByName(extra)
    agg = counts.groupBy("rk").agg(F.sum("concordant").alias("concordant"), F.sum("discordant").alias("discordant"))
    if by:
        schema = T.StructType([f for f in df.schema.fields if f.name in by])
        agg = agg.select(F.from_json("rk", schema).alias("k"), "concordant", "discordant").select(
            *[F.col(f"k.{c}").alias(c) for c in by], "concordant", "discordant")
    else:
        agg = agg.drop("rk")
    return agg.withColumns({
        "concordant": F.round("concordant").cast("long"), "discordant": F.round("discordant").cast("long")})


def pairwise_accuracy(df: DataFrame, block_cols: Sequence[str], actual: str = "stage_a_residual",
                      pred: str = "stage_b_pred", by: Sequence[str] = (), **kw) -> DataFrame:
    """accuracy = concordant / (concordant + discordant); null without pairs.

    Always returns one row per ``by`` key (one row overall when ``by`` is empty).
    """
    counts = concordance_counts(df, block_cols, actual, pred, by, **kw)
    if not by:
        one = df.sparkSession.range(1).select(F.lit(1).alias("_one"))
        counts = one.join(counts.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")
    pairs = F.coalesce(F.col("concordant"), F.lit(0)) + F.coalesce(F.col("discordant"), F.lit(0))
    return counts.select(*by, F.coalesce(F.col("concordant"), F.lit(0)).alias("concordant"), pairs.alias("pairs"),
                         F.when(pairs > 0, F.col("concordant") / pairs).alias("pairwise_accuracy"))


# ---------------------------------------------------------------------------
# Sign accuracy per model inside capped groups (notebook variant)
# ---------------------------------------------------------------------------
ISCLOSE_ATOL = 1e-8


def pairwise_signs(df: DataFrame, block_cols: Sequence[str], actual: str, preds: Sequence[str],
                   cap: int = 30, seed: int = 42, id_col: str = "post_id") -> DataFrame:
    """Per block and model, pairs with |Δactual| > 1e-8; correct when the
    predicted difference has the same (non-zero) sign.  Blocks are capped at
    ``cap`` rows by a seeded hash sample (W8), so each pandas group is bounded
    (≤ cap rows, ≤ cap·(cap−1)/2 pairs counted in memory, never emitted)."""
    from riselens.operators.stats import cap_per_group
    capped = cap_per_group(df.select(id_col, *block_cols, actual, *preds), list(block_cols), cap, seed, id_col)
    key = F.to_json(F.struct(*[F.col(c) for c in block_cols]))
    models = list(preds)

    def count_block(bk, a: np.ndarray, preds: dict, rows: list) -> None:
        iu = np.triu_indices(len(a), 1)
        da = (a[:, None] - a[None, :])[iu]
        keep = np.abs(da) > ISCLOSE_ATOL
        n_keep = int(keep.sum())
        for m in models:
            p = preds[m]
            dp = (p[:, None] - p[None, :])[iu]
            ok = keep & (np.sign(dp) == np.sign(da)) & (dp != 0)
            rows.append((bk, m, int(ok.sum()), n_keep))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        # many capped blocks (<= cap rows each) per call: one bucket of blocks
        rows: list = []
        for bk, g in pdf.groupby("bk", sort=False):
            count_block(bk, g["a"].to_numpy(dtype=np.float64),
                        {m: g[m].to_numpy(dtype=np.float64) for m in models}, rows)
        return pd.DataFrame(rows, columns=["bk", "model", "correct", "pairs"])

    n_buckets = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")) * 4)
    res = capped.select(key.alias("bk"), F.col(actual).cast("double").alias("a"),
                        *[F.col(m).cast("double").alias(m) for m in models]).withColumn(
        "_b", F.pmod(F.xxhash64("bk"), F.lit(n_buckets))).groupBy("_b").applyInPandas(
        count, "bk string, model string, correct long, pairs long")
    schema = T.StructType([f for f in df.schema.fields if f.name in block_cols])
    res = res.filter(F.col("pairs") > 0)
    return res.select(F.from_json("bk", schema).alias("k"), "model", "correct", "pairs").select(
        *[F.col(f"k.{c}").alias(c) for c in block_cols], "model", "correct", "pairs")


def pairwise_report(signs: DataFrame, grains: Sequence[Sequence[str]], baseline: str | None = None) -> DataFrame:
    """Accuracy per model at several grains in one GROUPING SETS pass, with
    the lift over a baseline model."""
    cols = sorted({c for g in grains for c in g})
    sets = ", ".join("(" + ", ".join(["model", *g]) + ")" for g in grains)
    view = f"_pair_signs_{uuid.uuid4().hex}"
    signs.createOrReplaceTempView(view)
    gid = " + ".join(f"grouping({c}) * {1 << i}" for i, c in enumerate(cols)) or "0"
    q = f"""SELECT model, {', '.join(cols)}, {gid} AS grain_id, sum(correct) AS correct, sum(pairs) AS pairs,
                   sum(correct) / nullif(sum(pairs), 0) AS accuracy
            FROM {view} GROUP BY GROUPING SETS ({sets})"""
    out = signs.sparkSession.sql(q)
    if baseline is None:
        return out
    base = out.filter(F.col("model") == baseline).select(
        *[F.col(c).alias(f"_b_{c}") for c in cols], F.col("grain_id").alias("_b_gid"),
        F.col("accuracy").alias("baseline_accuracy"))
    cond = F.col("grain_id") == F.col("_b_gid")
    for c in cols:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    j = out.join(base, cond, "left").drop(*[f"_b_{c}" for c in cols], "_b_gid")
    return j.withColumn("lift_vs_baseline", F.col("accuracy") - F.col("baseline_accuracy"))
