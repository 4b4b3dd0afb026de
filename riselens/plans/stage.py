"""Two-stage model (M1–M11, M16, M19, M21) and its evaluation.

Data flow: the prepared frame (M1) is ranked by time once (distributed rank),
the split and fold boundaries become rank intervals, and ONE pass computes an
augmented Gram per interval over [Stage A design, Stage B design, target].
Everything else — Stage A OLS, its residual, the Stage B scaler, variance
filter, elastic-net CV over l1 × alpha, Stage B OLS, train/test metrics — is
matrix algebra on those Grams on the driver.  The community factor has any
number of levels: it is eliminated by per-level sums (``operators.factors``),
and its effects stay a distributed table.  Per-row outputs (predictions,
residuals) are one join with that table and a projection with the coefficients
as literals, and the pairwise evaluation counts pairs on the test rows
(``operators.pairwise``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riselens.functions.context import interaction_features
from riselens.operators import factors as X
from riselens.operators import gram as G
from riselens.operators.order import global_rank
from riselens.session import checkpoint

# ---------------------------------------------------------------------------
# The design column lists and search grids of the studied model
# ---------------------------------------------------------------------------
STAGE_A_CONTEXT_COLS = [
    "log_score_5m", "velocity_5_to_30m", "is_text_post", "is_image_post", "is_news_post",
    "is_external_link", "has_author", "author_post_count", "author_post_count_log",
    "author_post_count_global", "author_avg_score", "is_frequent_poster", "hour_of_day",
    "is_weekend", "is_morning", "is_afternoon", "is_evening", "is_night", "is_recent", "is_old",
    "is_new_collection", "subreddit_post_count", "subreddit_post_count_global",
    "subreddit_avg_score", "subreddit_median_score", "subreddit_score_std", "hour_sin", "hour_cos",
]
STAGE_B_TITLE_COLS = [
    "title_length", "title_words", "title_chars_per_word", "has_question", "has_exclamation",
    "punctuation_count", "all_caps_words", "capitalization_ratio", "number_count", "has_numbers",
    "sentiment_compound", "sentiment_positive", "sentiment_negative", "sentiment_neutral",
    "flesch_kincaid_grade", "avg_word_length", "type_token_ratio", "clickbait_keywords",
    "clickbait_patterns", "has_clickbait", "person_entities", "org_entities", "date_entities",
    "total_entities",
]
STAGE_B_INTERACTION_COLS = [
    "sentiment_compound_offpeak", "sentiment_negative_offpeak", "sentiment_positive_offpeak",
    "has_numbers_offpeak", "clickbait_patterns_offpeak", "sentiment_compound_weekend",
    "has_question_weekend",
]
ENET_L1_RATIOS = [0.05, 0.25, 0.5, 0.75, 0.9]
ENET_ALPHAS = list(np.logspace(-3, 2, 30))
CV_FOLDS = 5
VARIANCE_FLOOR = 1e-8
TARGET = "stage_a_target"
FACTOR = "subreddit"
# ---------------------------------------------------------------------------


def _first_present(df: DataFrame, names: Sequence[str]) -> Column:
    for n in names:
        if n in df.columns:
            return F.col(n).cast("double")
    return F.lit(None).cast("double")


def prepare_stage(features: DataFrame, platform: str | None = None) -> DataFrame:
    """M1 / NM13: platform filter (all by default), score fallbacks, targets, default fills (A4).

    Posts without a time cannot be split or ranked by it and go, as in J3."""
    df = features.filter(F.col("created_timestamp").isNotNull())
    df = df if platform is None else df.filter(F.col("platform") == platform)
    s5 = F.coalesce(_first_present(df, ["score_5m", "score_at_5min"]), F.lit(0.0))
    s30 = F.coalesce(_first_present(df, ["score_30m", "score_at_30min"]), s5)
    s60 = F.coalesce(_first_present(df, ["score_60m", "score_at_60min", "score_at_30min"]), F.col("score").cast("double"))
    df = df.withColumns({"_s5": F.greatest(s5, F.lit(0.0)), "_s30": F.greatest(s30, F.lit(0.0)),
                         "_s60": F.greatest(s60, F.lit(0.0))})
    cols = {
        "created_dt": F.timestamp_micros(F.round(F.col("created_timestamp") * 1_000_000).cast("long")),
        "score_5m": F.col("_s5"), "score_30m": F.col("_s30"), "score_60m": F.col("_s60"),
        "log_score_5m": F.log1p(F.col("_s5")),
        "velocity_5_to_30m": F.coalesce((F.col("_s30") - F.col("_s5")) / F.lit(25.0), F.lit(0.0)),
        TARGET: F.log1p(F.col("_s60")),
    }
    if "author_post_count_log" not in df.columns and "author_post_count" in df.columns:
        cols["author_post_count_log"] = F.log1p(F.greatest(F.col("author_post_count"), F.lit(0)))
    for c in ("is_new_collection", "author_post_count_global", "subreddit_post_count",
              "subreddit_post_count_global", "subreddit_score_std"):
        cols[c] = F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    for c in ("hour_sin", "hour_cos"):
        if c not in df.columns:
            cols[c] = F.lit(0.0)
    df = df.withColumns(cols).drop("_s5", "_s30", "_s60")
    # Global score mean as the fallback of the three group means (one-row broadcast).
    mean = df.agg(F.avg(F.col("score").cast("double")).alias("_score_mean"))
    df = df.crossJoin(F.broadcast(mean))
    fills = {}
    for c in ("subreddit_avg_score", "subreddit_median_score", "author_avg_score"):
        fills[c] = F.coalesce(F.col(c).cast("double"), F.col("_score_mean")) if c in df.columns else F.col("_score_mean")
    return df.withColumns(fills).drop("_score_mean")


def with_interactions(df: DataFrame) -> DataFrame:
    """M7 / C12 (interactions added before the split: quirk Q3 fixed)."""
    return df.withColumns(interaction_features("hour_of_day", "day_of_week"))


@dataclass
class Design:
    """M2: fitted level lists (from train) and the resulting design columns.

    Hours and weekdays become dummies; the community is a factor of any number
    of levels and never a column.
    """

    hours: list
    dows: list
    stage_b: list[str] = field(default_factory=lambda: STAGE_B_TITLE_COLS + STAGE_B_INTERACTION_COLS)

    def dummy_specs(self) -> list[tuple[str, str, object]]:
        """(dummy name, source column, level); the first level of each is dropped."""
        return ([(f"hour_{h}", "hour_of_day", h) for h in self.hours[1:]]
                + [(f"dow_{d}", "day_of_week", d) for d in self.dows[1:]])

    def dummy_exprs(self) -> dict[str, Column]:
        return {name: G.indicator(src, lv) for name, src, lv in self.dummy_specs()}

    @property
    def stage_a(self) -> list[str]:
        return STAGE_A_CONTEXT_COLS + [name for name, _, _ in self.dummy_specs()]

    def transform(self, df: DataFrame) -> DataFrame:
        """Unseen levels get all-zero dummies (Q6 fixed: levels from train)."""
        return df.withColumns(self.dummy_exprs())


def fit_design(train: DataFrame) -> Design:
    """Hours (24) and weekdays (7) present in the training rows: bounded by construction."""
    lv = train.agg(
        F.sort_array(F.collect_set("hour_of_day")).alias("h"),
        F.sort_array(F.collect_set("day_of_week")).alias("d"),
    ).collect()[0]
    return Design(list(lv["h"]), list(lv["d"]))


def fold_bounds(n: int, k: int) -> list[int]:
    """Contiguous k-fold starts (first n % k folds one larger), plus n."""
    sizes = [n // k + (1 if i < n % k else 0) for i in range(k)]
    out = [0]
    for s in sizes:
        out.append(out[-1] + s)
    return out


def ranked_frame(frame: DataFrame, ts: str = "created_timestamp", tie: str = "post_id") -> DataFrame:
    """Rows with a 0-based global time rank (distributed, lineage cut)."""
    return global_rank(frame, [ts, tie], "time_rank")


def interval_key(rank: Column, bounds: Sequence[int], labels: Sequence[str]) -> Column:
    """Label of the rank interval [bounds[i], bounds[i+1]) (null outside)."""
    expr = None
    for i, lab in enumerate(labels):
        cond = (rank >= F.lit(bounds[i])) & (rank < F.lit(bounds[i + 1]))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


@dataclass
class TwoStageFit:
    design: Design
    stage_a: G.LinearFit            # with the column X.EFFECT, the effect of the row's community
    stage_b: G.LinearFit            # elastic net on standardized active columns
    stage_b_ols: G.LinearFit
    scaler_mean: np.ndarray
    scaler_std: np.ndarray
    active: list[str]
    cv: dict
    metrics: dict
    name: str = "all"               # of this fit in the tables of community effects
    effects: DataFrame | None = None
    base: list[float] = field(default_factory=lambda: [0.0])

    def stage_b_raw(self) -> G.LinearFit:
        """Stage B coefficients on the raw (unscaled) columns."""
        b = self.stage_b
        pos = {c: i for i, c in enumerate(self.design.stage_b)}
        mu = np.array([self.scaler_mean[pos[c]] for c in b.features])
        sd = np.array([self.scaler_std[pos[c]] for c in b.features])
        coef = b.coef / sd
        return G.LinearFit(b.features, coef, float(b.intercept - np.sum(mu * coef)), b.n, {})


def solve_many(grams: dict[tuple[str, str], G.AugGram], levels: DataFrame, designs: dict[str, Design], cols: Sequence[str],
               l1_ratios=ENET_L1_RATIOS, alphas=ENET_ALPHAS) -> dict[str, TwoStageFit]:
    """All fits at once, from Grams by (fit, part) and the written level table
    of the same fits and parts ("f0"... are the training folds, "test" the rest).

    Three passes over the level table whatever the number of fits: what the
    levels explain, their effects, and the effects' moments in every part.
    """
    train = checkpoint(X.merge_parts(levels.where("part <> 'test'")))
    between = X.between_grams(train, cols)
    folds = {f: [grams.get((f, f"f{i}"), G.AugGram.zeros(cols)) for i in range(CV_FOLDS)] for f in designs}
    none = G.AugGram.zeros(cols), 0
    stage_a = {f: X.fit_absorbed(G.sum_grams(folds[f], cols), *between.get(f, none), d.stage_a, TARGET) for f, d in designs.items()}
    effects = X.level_effects(train, stage_a, cols, TARGET)
    base = X.base_effects(effects)
    moments = X.effect_moments(levels, effects, base, cols)
    out = {}
    for f, design in designs.items():
        own = [X.with_effect(g, moments.get((f, f"f{i}"))) for i, g in enumerate(folds[f])]
        test = X.with_effect(grams.get((f, "test"), G.AugGram.zeros(cols)), moments.get((f, "test")))
        fit = solve_two_stage(own, test, design, stage_a[f], l1_ratios, alphas)
        fit.name, fit.effects, fit.base = f, effects, base.get(f, [0.0])
        out[f] = fit
    return out


def solve_two_stage(train_folds: Sequence[G.AugGram], test: G.AugGram, design: Design, fa: G.LinearFit,
                    l1_ratios=ENET_L1_RATIOS, alphas=ENET_ALPHAS) -> TwoStageFit:
    """Driver solve from fold Grams (train = sum of folds), the test Gram and Stage A's fit."""
    names = train_folds[0].names
    train = G.sum_grams(train_folds, names)
    xb = design.stage_b
    ma_tr, ma_te = G.metrics(train, fa, TARGET), G.metrics(test, fa, TARGET)
    # Residual of Stage A appended to every Gram.
    rf = [G.residual_gram(g, fa, TARGET, "stage_a_residual") for g in train_folds]
    rt = G.residual_gram(test, fa, TARGET, "stage_a_residual")
    rtrain = G.sum_grams(rf, rf[0].names)
    mean, std = G.scaler_from_gram(rtrain, xb, ddof=0)
    sf = [G.standardize(g, xb, mean, std) for g in rf]
    st = G.standardize(rt, xb, mean, std)
    strain = G.sum_grams(sf, sf[0].names)
    n = strain.n
    _, _, _, sxx, _, _ = strain.block(xb, "stage_a_residual")
    var1 = np.diag(sxx) / (n - 1) if n > 1 else np.zeros(len(xb))
    active = [c for c, v in zip(xb, var1) if v > VARIANCE_FLOOR] or list(xb)
    fb, cv = G.fit_elastic_net_cv(sf, active, "stage_a_residual", l1_ratios, alphas, max_iter=20000, tol=1e-4)
    fo = G.fit_ols(strain, active, "stage_a_residual")
    mets = {
        "stage_a": {"train": ma_tr, "test": ma_te},
        "stage_b": {"train": G.metrics(strain, fb, "stage_a_residual"), "test": G.metrics(st, fb, "stage_a_residual")},
        "stage_b_ols": {"train": G.metrics(strain, fo, "stage_a_residual"), "test": G.metrics(st, fo, "stage_a_residual")},
    }
    return TwoStageFit(design, fa, fb, fo, mean, std, active, cv, mets)


def stage_columns(design: Design) -> list[str]:
    return design.stage_a + design.stage_b + [TARGET]


def score(df: DataFrame, fit: TwoStageFit) -> DataFrame:
    """Per-row predictions and residuals as one projection."""
    pa = fit.stage_a.predict_expr()
    pb = fit.stage_b_raw().predict_expr()
    d = X.attach_effect(fit.design.transform(df), FACTOR, fit.effects, fit.name, fit.base)
    d = d.withColumn("stage_a_pred", pa).withColumn("stage_a_residual", F.col(TARGET) - F.col("stage_a_pred"))
    return d.withColumns({"stage_b_pred": pb}).withColumns({
        "combined_pred": F.col("stage_a_pred") + F.col("stage_b_pred"),
        "title_lift_component": F.col("stage_b_pred"),
    })


def run_stage_model(frame: DataFrame, q: float = 0.7, folds: int = CV_FOLDS,
                    l1_ratios=ENET_L1_RATIOS, alphas=ENET_ALPHAS, ranked: DataFrame | None = None) -> tuple[TwoStageFit, DataFrame, dict]:
    """Fit on the time split at quantile ``q``; return fit, scored rows, info.

    ``ranked``: the frame with interactions and time ranks, where it is at hand.

    Actions: one rank (sort + counts), one Gram pass, one pass of level sums,
    and the passes of ``solve_many`` over the level table.
    """
    from riselens.operators.order import quantiles_of_ranked
    r = ranked_frame(with_interactions(frame)) if ranked is None else ranked
    n = r.count()
    split_time = quantiles_of_ranked(r, "time_rank", "created_timestamp", n, [q])[0]
    n_train = r.filter(F.col("created_timestamp") <= F.lit(split_time)).count()
    design = fit_design(r.filter(F.col("time_rank") < n_train))
    fb = fold_bounds(n_train, folds)
    labels = [f"f{i}" for i in range(folds)] + ["test"]
    key = interval_key(F.col("time_rank"), fb + [n], labels)
    d, names = design.transform(r), stage_columns(design)
    grams = {("all", part): g for part, g in G.gram_by_key(d, names, key).items()}
    levels = checkpoint(X.level_sums(d, FACTOR, names, part=key))
    fit = solve_many(grams, levels, {"all": design}, names, l1_ratios, alphas)["all"]
    scored = score(r, fit).withColumn("split", F.when(F.col("time_rank") < n_train, F.lit("train")).otherwise(F.lit("test")))
    info = {"split_quantile": q, "split_time": split_time, "train_count": n_train, "test_count": n - n_train}
    return fit, scored, info
