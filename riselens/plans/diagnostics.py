"""Resampling diagnostics (E7–E13) from one pass of bucket Grams.

Every split the studied diagnostics refit — temporal quantile splits (E7),
expanding daily blocks (E8), learning-curve prefixes (E11) — is a train set
that is a *prefix in time order* plus contiguous CV folds inside it, and a
test set that is a rank interval.  So all their boundaries are rank cut
points: the ranked frame is bucketed by the union of cut points and ONE pass
computes an augmented Gram per bucket.  Each split's fold and test Grams are
sums of buckets; the solve is ``stage.solve_two_stage`` on the driver.

The design is a superset (dummies for every hour and weekday); for each training
set the levels present there are selected and the first one dropped, as a
per-split ``get_dummies(drop_first=True)`` would do.  Communities are eliminated
(``operators.factors``): the same buckets give sums per community, which are
spread to the splits and folds a bucket belongs to, and all splits are solved
together (``stage.solve_many``).

Pairwise accuracy for all splits is one counting job: each test row is
exploded once per split it belongs to, with that split's prediction.

Bootstrap (E9) uses Poisson(1) replicate weights from a seeded hash of the
post id (the standard distributed bootstrap), computed inside the Gram
partials, so rows are never copied per replicate.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riselens.operators import factors as X
from riselens.operators import gram as G
from riselens.operators.joins import attach_small
from riselens.operators.order import quantiles_of_ranked
from riselens.operators.pairwise import pairwise_accuracy
from riselens.plans import stage as S
from riselens.session import checkpoint

# Function defaults of the studied diagnostics (their CLI used other values).
MIN_TRAIN, MIN_TEST, MIN_TARGET_STD, MIN_STAGE_B_RMSE = 200, 100, 1e-6, 0.05
BOOT_MIN_OOB_RATIO, BOOT_MIN_OOB, BOOT_MAX_ABS_SKEW = 0.1, 50, 10.0


@dataclass
class FullDesign:
    hours: list
    dows: list

    def specs(self):
        return ([(f"hour_{h}", "hour_of_day", h, "h") for h in self.hours]
                + [(f"dow_{d}", "day_of_week", d, "d") for d in self.dows])

    def exprs(self) -> dict[str, Column]:
        return {n: G.indicator(src, lv) for n, src, lv, _ in self.specs()}

    @property
    def all_columns(self) -> list[str]:
        return (S.STAGE_A_CONTEXT_COLS + [n for n, *_ in self.specs()]
                + S.STAGE_B_TITLE_COLS + S.STAGE_B_INTERACTION_COLS + [S.TARGET])

    def for_train(self, train: G.AugGram) -> S.Design:
        """Levels present in the training Gram, first one dropped."""
        present = {"h": [], "d": []}
        for name, _, lv, kind in self.specs():
            if train.U[0, train.idx([name])[0]] > 0:
                present[kind].append(lv)
        return S.Design(present["h"], present["d"])


def fit_full_design(frame: DataFrame) -> FullDesign:
    d = S.fit_design(frame)
    return FullDesign(d.hours, d.dows)


@dataclass
class Split:
    """Train = ranks [0, train_end) in contiguous folds, test = ranks [lo, hi)."""

    name: str
    train_end: int
    lo: int
    hi: int

    def parts(self, folds: int) -> list[tuple[str, int, int]]:
        fb = S.fold_bounds(self.train_end, folds)
        return [*((f"f{i}", fb[i], fb[i + 1]) for i in range(folds)), ("test", self.lo, self.hi)]


def solve_splits(prep: Prepared, splits: Sequence[Split], folds: int = S.CV_FOLDS,
                 accept=lambda train, test: True) -> dict[str, tuple[S.TwoStageFit, G.AugGram, G.AugGram]]:
    """(fit, train Gram, test Gram) of every accepted split, by name.

    One pass over the rows for the bucket Grams and one for the community sums
    of the buckets; what follows reads the sums only.
    """
    cuts = [c for s in splits for _, lo, hi in s.parts(folds) for c in (lo, hi)]
    bounds, bid = buckets_of(prep, cuts)
    d = prep.ranked.withColumns(prep.fd.exprs())
    buckets = {int(k): v for k, v in G.gram_by_key(d, prep.names, bid).items()}
    pos = {b: i for i, b in enumerate(bounds)}
    grams, designs, members = {}, {}, []
    for s in splits:
        spans = {part: range(pos[lo], pos[hi]) for part, lo, hi in s.parts(folds)}
        own = {part: G.sum_grams([buckets.get(i, G.AugGram.zeros(prep.names)) for i in span], prep.names) for part, span in spans.items()}
        train = G.sum_grams([g for part, g in own.items() if part != "test"], prep.names)
        if not accept(train, own["test"]):
            continue
        grams |= {(s.name, part): g for part, g in own.items()}
        designs[s.name] = prep.fd.for_train(train)
        members += [(str(i), s.name, part) for part, span in spans.items() for i in span]
    if not designs:
        return {}
    sums = checkpoint(X.level_sums(d, S.FACTOR, prep.names, part=bid))
    moments = [c for c in sums.columns if c not in ("fit", "part", "level")]
    of = prep.ranked.sparkSession.createDataFrame(members, "bucket string, fit string, member string")
    spread = sums.drop("fit").withColumnRenamed("part", "bucket").join(F.broadcast(of), "bucket")  # as many rows as buckets of splits
    levels = checkpoint(spread.groupBy("fit", F.col("member").alias("part"), "level").agg(*[F.expr(f"sum({c}) AS {c}") for c in moments]))
    fits = S.solve_many(grams, levels, designs, prep.names)
    train_of = {f: G.sum_grams([grams[f, f"f{i}"] for i in range(folds)], prep.names) for f in fits}
    return {f: (fit, train_of[f], grams[f, "test"]) for f, fit in fits.items()}


def _target_std(g: G.AugGram) -> float:
    n, _, _, _, _, syy = g.block([], S.TARGET)
    return float(np.sqrt(syy / (n - 1))) if n > 1 else 0.0


def _record(fit: S.TwoStageFit, **extra) -> dict:
    m = fit.metrics
    rec = {
        "stage_a_train_rmse": m["stage_a"]["train"]["rmse"], "stage_a_train_r2": m["stage_a"]["train"]["r2"],
        "stage_a_test_rmse": m["stage_a"]["test"]["rmse"], "stage_a_test_r2": m["stage_a"]["test"]["r2"],
        "stage_b_train_rmse": m["stage_b"]["train"]["rmse"], "stage_b_train_r2": m["stage_b"]["train"]["r2"],
        "stage_b_test_rmse": m["stage_b"]["test"]["rmse"], "stage_b_test_r2": m["stage_b"]["test"]["r2"],
    }
    rec["stage_a_gap_rmse"] = (rec["stage_a_test_rmse"] or 0) - (rec["stage_a_train_rmse"] or 0)
    rec["stage_b_gap_rmse"] = (rec["stage_b_test_rmse"] or 0) - (rec["stage_b_train_rmse"] or 0)
    rec.update(extra)
    return rec


def _pairwise_for(ranked: DataFrame, fd: FullDesign, specs: list[tuple[str, int, int, S.TwoStageFit]]) -> dict:
    """E2 for many splits in one counting job; specs = (label, lo, hi, fit).

    Each split's Stage A residual (but for the community effect, which is joined
    by split and community) and Stage B prediction are linear in the design
    columns, so one ``mapInPandas`` pass computes them for every split as ``X·Wᵀ``
    per batch and emits a row per (split, test row); the pairs are then counted
    by ``pairwise_accuracy`` with the split as report key.
    """
    if not specs:
        return {}
    names = sorted({c for _, _, _, f in specs for c in f.stage_a.features + f.stage_b_raw().features} - {X.EFFECT})
    pos = {c: i for i, c in enumerate(names)}

    def weights(lf):
        w = np.zeros(len(names))
        for c, b in zip(lf.features, lf.coef):
            if c != X.EFFECT:
                w[pos[c]] = b
        return w

    Wa = np.array([weights(f.stage_a) for _, _, _, f in specs])
    ba = np.array([f.stage_a.intercept for _, _, _, f in specs])
    rawb = [f.stage_b_raw() for _, _, _, f in specs]
    Wb = np.array([weights(f) for f in rawb])
    bb = np.array([f.intercept for f in rawb])
    lo = np.array([s[1] for s in specs])
    hi = np.array([s[2] for s in specs])
    labels = [s[0] for s in specs]
    src = ranked.withColumns(fd.exprs()).select(
        "subreddit", F.date_trunc("hour", "created_dt").alias("hour_bucket"), "time_rank",
        F.col(S.TARGET).cast("double").alias("_y"),
        *[G.filled(c, f"_x{i}") for i, c in enumerate(names)])
    xcols = [f"_x{i}" for i in range(len(names))]

    def explode_splits(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            Z = pdf[xcols].to_numpy(dtype=np.float64)
            rank = pdf["time_rank"].to_numpy()
            actual = pdf["_y"].to_numpy(dtype=np.float64)[:, None] - Z @ Wa.T - ba[None, :]
            pred = Z @ Wb.T + bb[None, :]
            member = (rank[:, None] >= lo[None, :]) & (rank[:, None] < hi[None, :])
            ri, si = np.nonzero(member)
            yield pd.DataFrame({
                "split_label": np.array(labels, dtype=object)[si],
                "subreddit": pdf["subreddit"].to_numpy()[ri],
                "hour_bucket": pdf["hour_bucket"].to_numpy()[ri],
                "actual": actual[ri, si], "pred": pred[ri, si]})

    schema = "split_label string, subreddit string, hour_bucket timestamp, actual double, pred double"
    ex = src.mapInPandas(explode_splits, schema)
    named = F.coalesce(*[F.when(F.col("fit") == f.name, F.lit(label)) for label, _, _, f in specs])
    effects = specs[0][3].effects.select(named.alias("split_label"), F.col("level").alias("_level"), F.col("e0").alias(X.EFFECT)).where("split_label IS NOT NULL")
    unseen = F.coalesce(*[F.when(F.col("split_label") == label, F.lit(float(f.base[0]))) for label, _, _, f in specs])
    ex = attach_small(ex.withColumn("_level", X.level_of("subreddit")), effects, ["split_label", "_level"], "left")
    ex = ex.withColumn("actual", F.col("actual") - F.coalesce(F.col(X.EFFECT), unseen)).drop("_level", X.EFFECT)
    res = pairwise_accuracy(ex, ["split_label", "subreddit", "hour_bucket"], "actual", "pred", by=["split_label"])
    return {r["split_label"]: (r["pairwise_accuracy"], r["pairs"]) for r in res.collect()}


@dataclass
class Prepared:
    ranked: DataFrame
    n: int
    fd: FullDesign
    names: list[str]


def prepare(frame: DataFrame, ranked: DataFrame | None = None) -> Prepared:
    ranked = S.ranked_frame(S.with_interactions(frame)) if ranked is None else ranked
    fd = fit_full_design(ranked)
    return Prepared(ranked, ranked.count(), fd, fd.all_columns)


def bucket_of(rank: Column, cuts: Sequence[int], offset: int = 0) -> Column:
    """Number of cut points <= rank as a balanced comparison tree: O(log n)
    comparisons per row however many splits, folds and days are cut."""
    if not cuts:
        return F.lit(offset)
    mid = len(cuts) // 2
    return F.when(rank < F.lit(cuts[mid]), bucket_of(rank, cuts[:mid], offset)).otherwise(
        bucket_of(rank, cuts[mid + 1:], offset + mid + 1))


def buckets_of(prep: Prepared, cuts: Iterable[int]) -> tuple[list[int], Column]:
    """Sorted cut points with both ends, and the number of a row's bucket between them."""
    bounds = sorted({0, prep.n, *[int(c) for c in cuts if 0 <= c <= prep.n]})
    return bounds, bucket_of(F.col("time_rank"), bounds[1:-1])


def temporal_splits(prep: Prepared, quantiles: Sequence[float] = (0.6, 0.65, 0.7, 0.75, 0.8),
                    folds: int = S.CV_FOLDS, pairwise: bool = True) -> pd.DataFrame:
    """One record per quantile (train <= quantile time)."""
    qs = [q for q in quantiles if 0 < q < 1]
    # the frame is ranked by (created_timestamp, post_id): read the quantile neighbours
    times = quantiles_of_ranked(prep.ranked, "time_rank", "created_timestamp", prep.n, qs)
    counts = prep.ranked.agg(*[F.count_if(F.col("created_timestamp") <= F.lit(t)).alias(f"c{i}")
                               for i, t in enumerate(times)]).collect()[0]
    n_train = [int(counts[f"c{i}"]) for i in range(len(qs))]
    some = [(q, t, nt) for q, t, nt in zip(qs, times, n_train) if 0 < nt < prep.n]
    found = solve_splits(prep, [Split(f"q{q}", nt, nt, prep.n) for q, _, nt in some], folds)
    recs, specs = [], []
    for q, t, nt in some:
        fit = found[f"q{q}"][0]
        recs.append(_record(fit, split_quantile=q, split_time=t, train_count=nt, test_count=prep.n - nt))
        specs.append((f"q{q}", nt, prep.n, fit))
    _attach_pairwise(prep, recs, specs, pairwise)
    return pd.DataFrame(recs)


def _attach_pairwise(prep, recs, specs, pairwise):
    pw = _pairwise_for(prep.ranked, prep.fd, specs) if pairwise else {}
    for rec, (label, *_rest) in zip(recs, specs):
        acc, pairs = pw.get(label, (None, 0))
        rec["pairwise_accuracy"] = acc
        rec["pairwise_pairs"] = int(pairs) if pairs else None


def blocked_cv(prep: Prepared, min_train: int = MIN_TRAIN, min_test: int = MIN_TEST,
               min_target_std: float = MIN_TARGET_STD, min_stage_b_rmse: float = MIN_STAGE_B_RMSE,
               folds: int = S.CV_FOLDS, pairwise: bool = True) -> pd.DataFrame:
    """Expanding daily blocks (train = all earlier days, test = the day)."""
    days = (prep.ranked.groupBy(F.to_date("created_dt").alias("day"))
            .agg(F.min("time_rank").alias("lo"), F.max("time_rank").alias("hi")).orderBy("day").collect())
    blocks = [(str(r["day"]), int(r["lo"]), int(r["hi"]) + 1) for r in days]
    some = [(day, lo, hi) for day, lo, hi in blocks if lo >= min_train and hi - lo >= min_test]
    varied = lambda train, test: min(_target_std(train), _target_std(test)) > min_target_std
    found = solve_splits(prep, [Split(day, lo, lo, hi) for day, lo, hi in some], folds, varied)
    recs, specs = [], []
    for day, lo, hi in some:
        if day not in found:
            continue
        fit = found[day][0]
        rb = fit.metrics["stage_b"]
        if min(rb["train"]["rmse"] or 0, rb["test"]["rmse"] or 0) < min_stage_b_rmse:
            continue
        recs.append(_record(fit, block=day, train_count=lo, test_count=hi - lo))
        specs.append((day, lo, hi, fit))
    _attach_pairwise(prep, recs, specs, pairwise)
    return pd.DataFrame(recs)


def learning_curve(prep: Prepared, base_quantile: float = 0.7, fractions: Sequence[float] = (0.3, 0.5, 0.7, 1.0),
                   min_train: int = 500, folds: int = S.CV_FOLDS, pairwise: bool = True) -> pd.DataFrame:
    """First floor(n_train·f) training rows in time order, fixed test."""
    t = quantiles_of_ranked(prep.ranked, "time_rank", "created_timestamp", prep.n, [base_quantile])[0]
    nt = prep.ranked.filter(F.col("created_timestamp") <= F.lit(t)).count()
    sizes = [(f, int(nt * f)) for f in fractions if 0 < f <= 1 and int(nt * f) >= min_train]
    found = solve_splits(prep, [Split(f"f{f}", m, nt, prep.n) for f, m in sizes], folds)
    recs, specs = [], []
    for f, m in sizes:
        fit = found[f"f{f}"][0]
        recs.append(_record(fit, fraction=f, train_count=m, test_count=prep.n - nt, base_split_time=t))
        specs.append((f"f{f}", nt, prep.n, fit))
    _attach_pairwise(prep, recs, specs, pairwise)
    return pd.DataFrame(recs)


# ---------------------------------------------------------------------------
# Bootstrap (E9) and its summary
# ---------------------------------------------------------------------------
_POISSON_CDF = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1)) if k else np.exp(-1.0) for k in range(20)])


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    """splitmix64 finaliser of (hash, salt): a deterministic 64-bit stream."""
    with np.errstate(over="ignore"):
        z = (h + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def replicate_weights(h: np.ndarray, rep: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Poisson(1) weight and CV fold (0..4) per row for replicate ``rep``."""
    u = (_mix(h, seed * 1_000_003 + 2 * rep) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    w = np.searchsorted(_POISSON_CDF, u, side="right").astype(np.float64)
    fold = (_mix(h, seed * 1_000_003 + 2 * rep + 1) % np.uint64(S.CV_FOLDS)).astype(np.int64)
    return w, fold


def bootstrap_grams(prep: Prepared, iterations: int, seed: int) -> dict[tuple[int, str], G.AugGram]:
    """Per replicate: in-bag Grams per CV fold (weighted) and the OOB Gram."""
    names = prep.names
    k = len(names) + 1
    src = prep.ranked.withColumns(prep.fd.exprs()).select(
        F.xxhash64("post_id").alias("_h"),
        *[G.filled(c, f"_x{i}") for i, c in enumerate(names)])
    xcols = [f"_x{i}" for i in range(len(names))]

    def partials(batches):
        acc: dict[str, np.ndarray] = {}
        for pdf in batches:
            if pdf.empty:
                continue
            Z = np.ones((len(pdf), k))
            Z[:, 1:] = pdf[xcols].to_numpy(dtype=np.float64)
            h = pdf["_h"].to_numpy().astype(np.uint64)
            for r in range(iterations):
                w, fold = replicate_weights(h, r, seed)
                oob = w == 0
                if oob.any():
                    Zo = Z[oob]
                    key = f"{r}|oob"
                    acc[key] = acc.get(key, 0) + Zo.T @ Zo
                for f in range(S.CV_FOLDS):
                    m = (fold == f) & ~oob
                    if m.any():
                        Zi = Z[m]
                        key = f"{r}|f{f}"
                        acc[key] = acc.get(key, 0) + (Zi * w[m][:, None]).T @ Zi
        yield from G.partial_frames({key: m.ravel() for key, m in acc.items()})

    res = {}
    for key, flat in G.reduce_partials(src.mapInPandas(partials, G.PARTIAL_SCHEMA)).items():
        rep, part = key.split("|")
        res[(int(rep), part)] = G.AugGram(names, flat.reshape(k, k))
    return res


def bootstrap_levels(prep: Prepared, iterations: int, seed: int) -> DataFrame:
    """Community sums per replicate and part ("f0"... in the bag, "test" out of it).

    Each batch sums its rows per (replicate, part, community) before anything
    is shuffled.
    """
    names = prep.names
    k = len(names) + 1
    src = prep.ranked.withColumns(prep.fd.exprs()).select(
        X.level_of(S.FACTOR).alias("_level"), F.xxhash64("post_id").alias("_h"),
        *[G.filled(c, f"_x{i}") for i, c in enumerate(names)])
    xcols = [f"_x{i}" for i in range(len(names))]
    parts = np.array([*(f"f{f}" for f in range(S.CV_FOLDS)), "test"], object)
    moments = ["d0_0", *[f"c0_{j}" for j in range(k)]]

    def sums(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            U = np.ones((len(pdf), k))
            U[:, 1:] = pdf[xcols].to_numpy(dtype=np.float64)
            h = pdf["_h"].to_numpy().astype(np.uint64)
            level, found = pd.factorize(pdf["_level"])
            for r in range(iterations):
                w, fold = replicate_weights(h, r, seed)
                key = level * len(parts) + np.where(w == 0, len(parts) - 1, fold)
                order = np.argsort(key, kind="stable")
                keys, first = np.unique(key[order], return_index=True)
                C = np.add.reduceat(U[order] * np.where(w == 0, 1.0, w)[order, None], first)
                out = pd.DataFrame(np.concatenate((C[:, :1], C), axis=1), columns=moments)
                out.insert(0, "level", np.asarray(found, object)[keys // len(parts)])
                out.insert(0, "part", parts[keys % len(parts)])
                out.insert(0, "fit", str(r))
                yield out

    schema = "fit string, part string, level string, " + ", ".join(f"{m} double" for m in moments)
    return src.mapInPandas(sums, schema).groupBy("fit", "part", "level").agg(*[F.expr(f"sum({m}) AS {m}") for m in moments])


def bootstrap(prep: Prepared, iterations: int = 30, seed: int = 42, min_oob_ratio: float = BOOT_MIN_OOB_RATIO,
              max_abs_skew: float = BOOT_MAX_ABS_SKEW) -> pd.DataFrame:
    """Per replicate fit on in-bag rows (weights), test on out-of-bag rows;
    replicates with too few OOB rows or |residual skew| above the limit are
    skipped.  The skew of each replicate's Stage A residual over all rows is
    one aggregate pass for all replicates."""
    grams = bootstrap_grams(prep, iterations, seed)
    names = prep.names
    min_oob = max(int(prep.n * min_oob_ratio), BOOT_MIN_OOB)
    parts, designs, n_in = {}, {}, {}
    for r in range(iterations):
        oob = grams.get((r, "oob"), G.AugGram.zeros(names))
        if oob.n < min_oob:
            continue
        folds = {(str(r), f"f{f}"): grams.get((r, f"f{f}"), G.AugGram.zeros(names)) for f in range(S.CV_FOLDS)}
        train = G.sum_grams(folds.values(), names)
        parts |= folds | {(str(r), "test"): oob}
        designs[str(r)], n_in[r] = prep.fd.for_train(train), train.n
    if not designs:
        return pd.DataFrame()
    solved = S.solve_many(parts, checkpoint(bootstrap_levels(prep, iterations, seed)), designs, names)
    fits = {r: (solved[str(r)], parts[str(r), "test"], n) for r, n in n_in.items()}
    mom = residual_moments(prep, {r: f for r, (f, _, _) in fits.items()})
    recs = []
    n = float(prep.n)
    adj = np.sqrt(n * (n - 1)) / (n - 2) if n > 2 else float("nan")
    for r, (fit, oob, n_in) in fits.items():
        skew = mom[r] * adj if mom.get(r) is not None else None
        if skew is not None and abs(skew) > max_abs_skew:
            continue
        recs.append(_record(fit, iteration=r, train_count=int(round(n_in)), test_count=int(round(oob.n)),
                            residual_skew=skew))
    return pd.DataFrame(recs)


def residual_moments(prep: Prepared, fits: dict) -> dict:
    """Population skewness g1 of each replicate's Stage A residual over all
    rows, for every replicate in ONE pass: per batch the residual matrix is
    y − X·Wᵀ − b (numpy), and Σr, Σr², Σr³ per replicate are summed."""
    keys = sorted(fits)
    stage_a = [fits[r].stage_a for r in keys]
    names = sorted({c for f in stage_a for c in f.features} - {X.EFFECT})
    W = np.array([[dict(zip(f.features, f.coef)).get(c, 0.0) for c in names] for f in stage_a])
    b = np.array([f.intercept for f in stage_a])
    effects = fits[keys[0]].effects.groupBy(F.col("level").alias("_level")).agg(
        F.map_from_entries(F.collect_list(F.struct("fit", "e0"))).alias("_e"))  # an entry per replicate
    own = F.array(*[F.coalesce(F.element_at("_e", fits[r].name), F.lit(float(fits[r].base[0]))) for r in keys])
    rows = attach_small(prep.ranked.withColumns(prep.fd.exprs()).withColumn("_level", X.level_of(S.FACTOR)), effects, "_level", "left")
    src = rows.select(
        F.col(S.TARGET).cast("double").alias("_y"), own.alias("_own"),
        *[G.filled(c, f"_x{i}") for i, c in enumerate(names)])
    xcols = [f"_x{i}" for i in range(len(names))]

    def part(batches):
        acc = np.zeros((3, len(keys)))
        n = 0
        for pdf in batches:
            if pdf.empty:
                continue
            R = pdf["_y"].to_numpy(dtype=np.float64)[:, None] - pdf[xcols].to_numpy(dtype=np.float64) @ W.T - b[None, :] - np.stack(pdf["_own"])
            acc += np.stack([R.sum(0), (R ** 2).sum(0), (R ** 3).sum(0)])
            n += len(pdf)
        yield pd.DataFrame({"_n": [n], "_s": [acc.tobytes()]})

    tot, n = np.zeros((3, len(keys))), 0
    for row in src.mapInPandas(part, "_n long, _s binary").collect():      # one row per partition
        tot += np.frombuffer(row["_s"], dtype=np.float64).reshape(3, len(keys))
        n += row["_n"]
    out = {}
    for j, r in enumerate(keys):
        if n < 3:
            out[r] = None
            continue
        m1 = tot[0, j] / n
        m2 = tot[1, j] / n - m1 ** 2
        m3 = tot[2, j] / n - 3 * m1 * tot[1, j] / n + 2 * m1 ** 3
        out[r] = float(m3 / m2 ** 1.5) if m2 > 0 else None
    return out


BOOT_METRICS = ["stage_a_train_rmse", "stage_a_test_rmse", "stage_b_train_rmse", "stage_b_test_rmse", "stage_b_test_r2"]


def summarize(records: DataFrame, metrics: Sequence[str] = tuple(BOOT_METRICS), frac: float = 0.1) -> DataFrame:
    """Unpivot replicate records, trimmed mean / std per metric."""
    from riselens.operators.stats import trimmed
    long = records.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics if m in records.columns
    ])).alias("s")).select("s.*")
    return trimmed(long, "metric", "value", frac)
