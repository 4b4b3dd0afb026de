"""Linear fits with a factor of any number of levels, by elimination.

A dummy per level would make the Gram matrix quadratic in the levels.  But the
block of a factor is block-diagonal: with per-row regressors ``d = [1, by...]``
inside a level (an own intercept, and own slopes for ``by``), a level only needs

    D = Σ w·d·dᵀ  (q×q)    and    C = Σ w·d·uᵀ  (q×k),   u = [1, cols...],

which are plain sums per level, kept as one distributed row each.  Eliminating
all levels from the Gram ``U`` of the other columns leaves the within-level
matrix ``U − Σ Cᵀ D⁺ C`` (the Schur complement), from which the slopes follow;
a level's own effects are ``D⁺ (C_y − C_x β)``.  The driver holds only k×k
matrices, one per fit, whatever the number of levels.

Many fits (splits, folds, replicates) are worked off together: level tables carry
a ``fit`` and a ``part`` column.  Levels unseen in training take the effects of
the fit's first level, as rows without any dummy would.  Null levels are a level
of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riselens.operators import gram as G
from riselens.operators.joins import attach_small
from riselens.session import checkpoint

EFFECT = "_effect"
NULL_LEVEL = "\0null"
#: A column counts as constant within the levels when its centred sum of squares is below this share of its raw one.
CONSTANT = 1e-10


def level_of(level: str) -> Column:
    return F.coalesce(F.col(level).cast("string"), F.lit(NULL_LEVEL))


def _moment_names(q: int, k: int) -> tuple[list[str], list[str]]:
    return [f"d{i}_{j}" for i in range(q) for j in range(i, q)], [f"c{i}_{j}" for i in range(q) for j in range(k)]


def level_sums(df: DataFrame, level: str, cols: Sequence[str], by: Sequence[str] = (), fit: Column | None = None,
               part: Column | None = None, weight: Column | None = None) -> DataFrame:
    """One row per (fit, part, level): the entries of D and C as sums (nulls count 0).

    A plain aggregate with map-side partial sums, so a level with a third of
    the rows costs one partial row per task.  Rows without fit or part go.
    """
    q, k = 1 + len(by), 1 + len(cols)
    fit = F.lit("all") if fit is None else fit
    part = F.lit("train") if part is None else part
    weight = F.lit(1.0) if weight is None else weight
    src = df.select(fit.cast("string").alias("fit"), part.cast("string").alias("part"), level_of(level).alias("level"),
                    weight.cast("double").alias("_w"), *[G.filled(c, f"_d{i}") for i, c in enumerate(by, 1)],
                    *[G.filled(c, f"_u{j}") for j, c in enumerate(cols, 1)])
    src = src.where("fit IS NOT NULL AND part IS NOT NULL AND _w <> 0")
    d = ["1.0D", *[f"_d{i}" for i in range(1, q)]]
    u = ["1.0D", *[f"_u{j}" for j in range(1, k)]]
    sums = [f"sum(_w * {d[i]} * {d[j]}) AS d{i}_{j}" for i in range(q) for j in range(i, q)]
    sums += [f"sum(_w * {d[i]} * {u[j]}) AS c{i}_{j}" for i in range(q) for j in range(k)]
    return src.groupBy("fit", "part", "level").agg(*[F.expr(s) for s in sums])


def merge_parts(levels: DataFrame, part: str = "train") -> DataFrame:
    """The sums of all parts of a fit's levels, as one part."""
    moments = [c for c in levels.columns if c not in ("fit", "part", "level")]
    out = levels.groupBy("fit", "level").agg(*[F.expr(f"sum({c}) AS {c}") for c in moments])
    return out.select("fit", F.lit(part).alias("part"), "level", *moments)


def _blocks(pdf: pd.DataFrame, q: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """D, its pseudo-inverse and C of the rows of a level table."""
    dn, cn = _moment_names(q, k)
    D = np.zeros((len(pdf), q, q))
    flat = pdf[dn].to_numpy(dtype=np.float64)
    for at, (i, j) in enumerate((i, j) for i in range(q) for j in range(i, q)):
        D[:, i, j] = D[:, j, i] = flat[:, at]
    C = pdf[cn].to_numpy(dtype=np.float64).reshape(len(pdf), q, k)
    unit = np.sqrt(np.clip(np.einsum("mii->mi", D), 0, None))
    unit = np.where(unit > 0, unit, 1.0)
    scale = unit[:, :, None] * unit[:, None, :]
    return D, np.linalg.pinv(D / scale, rcond=1e-10, hermitian=True) / scale, C


def between_grams(train: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> dict[str, tuple[G.AugGram, int]]:
    """Per fit the part of the Gram that the levels explain, Σ Cᵀ D⁺ C, and the rank they take up."""
    q, k = 1 + len(by), 1 + len(cols)

    def partials(batches):
        acc: dict[str, np.ndarray] = {}
        for pdf in batches:
            if pdf.empty:
                continue
            D, inverse, C = _blocks(pdf, q, k)
            rank = np.rint(np.einsum("mij,mji->m", D, inverse))
            codes, fits = pd.factorize(pdf["fit"])
            for at, name in enumerate(fits):
                own = codes == at
                X = np.concatenate(C[own].transpose(0, 2, 1) @ inverse[own], axis=1)
                part = X @ np.concatenate(C[own], axis=0)
                tot = np.append(part.ravel(), rank[own].sum())
                acc[name] = acc[name] + tot if name in acc else tot
        yield from G.partial_frames(acc)

    out = {}
    for name, flat in G.reduce_partials(train.mapInPandas(partials, G.PARTIAL_SCHEMA)).items():
        out[name] = G.AugGram(list(cols), flat[:-1].reshape(k, k)), int(round(flat[-1]))
    return out


def fit_absorbed(total: G.AugGram, between: G.AugGram, taken: int, x: Sequence[str], y: str, rcond: float = 1e-12) -> G.LinearFit:
    """OLS of y on x and the factor: slopes of x, and EFFECT (coefficient 1) for the rows' level effects.

    Columns that are constant within all levels are explained by the factor and
    get 0, with a null standard error.  Slopes, standard errors, rank and
    residual sum equal those of the model with a dummy per level.
    """
    ix, iy = total.idx(x), total.idx([y])[0]
    W = total.U - between.U
    raw = np.diag(total.U)[ix]
    sxx, sxy, syy = W[np.ix_(ix, ix)], W[ix, iy], float(W[iy, iy])
    diag = np.clip(np.diag(sxx), 0, None)
    varies = diag > CONSTANT * raw
    unit = np.where(varies, np.sqrt(np.where(varies, diag, 1.0)), 1.0)
    live = np.ix_(varies, varies)
    scale = np.outer(unit, unit)[live]
    corr = sxx[live] / scale
    inverse = np.linalg.pinv(corr, rcond=max(rcond, 1e-11), hermitian=True) / scale if varies.any() else np.zeros((0, 0))
    beta = np.zeros(len(x))
    beta[varies] = inverse @ sxy[varies]
    rank = int(np.linalg.matrix_rank(corr, tol=1e-10 * max(1, varies.sum()), hermitian=True)) if varies.any() else 0
    rss = max(float(syy - 2 * beta @ sxy + beta @ sxx @ beta), 0.0)
    dof = total.n - taken - rank
    sigma2 = rss / dof if dof > 0 else float("nan")
    se = np.full(len(x) + 1, np.nan)
    se[:-1][varies] = np.sqrt(np.clip(np.diag(inverse) * sigma2, 0, None))
    coef = np.append(beta, 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(se > 0, coef / se, np.nan)
    return G.LinearFit([*x, EFFECT], coef, 0.0, total.n, {"std_err": se, "t_value": t, "rss": rss, "rank": rank + taken - 1, "sigma2": sigma2})


def level_effects(train: DataFrame, fits: dict[str, G.LinearFit], cols: Sequence[str], y: str, by: Sequence[str] = ()) -> DataFrame:
    """(fit, level, n, e0, e1...): every level's own intercept and slopes, written once.

    Levels stay distributed; only the slopes of each fit go into the tasks.
    """
    q, k = 1 + len(by), 1 + len(cols)
    at = {c: j for j, c in enumerate(cols, 1)}
    weights = {}
    for name, fit in fits.items():
        w = np.zeros(k)
        w[at[y]] = 1.0
        for c, b in zip(fit.features, fit.coef):
            if c != EFFECT:
                w[at[c]] -= b
        weights[name] = w
    names = [f"e{i}" for i in range(q)]

    def solve(batches):
        for pdf in batches:
            pdf = pdf[pdf["fit"].isin(list(weights))]
            if pdf.empty:
                continue
            D, inverse, C = _blocks(pdf, q, k)
            W = np.stack([weights[f] for f in pdf["fit"]])
            e = np.einsum("mij,mjk,mk->mi", inverse, C, W)
            yield pd.DataFrame({"fit": pdf["fit"].to_numpy(), "level": pdf["level"].to_numpy(), "n": D[:, 0, 0], **{n: e[:, i] for i, n in enumerate(names)}})

    schema = "fit string, level string, n double, " + ", ".join(f"{n} double" for n in names)
    return checkpoint(train.mapInPandas(solve, schema))


def base_effects(effects: DataFrame) -> dict[str, list[float]]:
    """Per fit the effects of its first level: what an unseen level gets."""
    names = [c for c in effects.columns if c.startswith("e")]
    rows = effects.groupBy("fit").agg(F.min_by(F.struct(*names), "level").alias("e")).collect()  # a row per fit
    return {r["fit"]: list(r["e"]) for r in rows}


def effect_moments(levels: DataFrame, effects: DataFrame, base: dict[str, list[float]], cols: Sequence[str], by: Sequence[str] = ()) -> dict[tuple[str, str], np.ndarray]:
    """Per (fit, part): Σ e·[1, cols...] and Σ e², with e the effect of each row's level."""
    q, k = 1 + len(by), 1 + len(cols)
    names = [f"e{i}" for i in range(q)]
    j = levels.join(effects.select("fit", "level", *names), ["fit", "level"], "left")
    for i, n in enumerate(names):
        default = F.coalesce(*[F.when(F.col("fit") == f, F.lit(float(b[i]))) for f, b in base.items()], F.lit(0.0))
        j = j.withColumn(n, F.coalesce(F.col(n), default))
    cross = [" + ".join(f"e{i} * c{i}_{c}" for i in range(q)) for c in range(k)]
    square = " + ".join(f"e{i} * e{m} * d{min(i, m)}_{max(i, m)}" for i in range(q) for m in range(q))
    rows = j.groupBy("fit", "part").agg(*[F.expr(f"sum({s}) AS m{c}") for c, s in enumerate([*cross, square])]).collect()
    return {(r["fit"], r["part"]): np.array([r[f"m{c}"] for c in range(k + 1)], dtype=float) for r in rows}


def with_effect(g: G.AugGram, moments: np.ndarray | None) -> G.AugGram:
    """The Gram with the level effect as one more column."""
    k = g.U.shape[0]
    U = np.zeros((k + 1, k + 1))
    U[:k, :k] = g.U
    if moments is not None:
        U[k, :k] = U[:k, k] = moments[:k]
        U[k, k] = moments[k]
    return G.AugGram([*g.names, EFFECT], U)


def attach_effect(df: DataFrame, level: str, effects: DataFrame, fit: str, base: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Rows with EFFECT, the effect of their level in one fit (broadcast only if the levels are few)."""
    names = [f"e{i}" for i in range(1 + len(by))]
    table = effects.where(F.col("fit") == fit).select(F.col("level").alias("_level"), *[F.col(n).alias(f"_{n}") for n in names])
    j = attach_small(df.withColumn("_level", level_of(level)), table, "_level", "left")
    value = F.lit(0.0)
    for i, n in enumerate(names):
        term = F.coalesce(F.col(f"_{n}"), F.lit(float(base[i])))
        value = value + (term if i == 0 else term * F.coalesce(F.col(by[i - 1]).cast("double"), F.lit(0.0)))
    return j.withColumn(EFFECT, value).drop("_level", *[f"_{n}" for n in names])


def fit_with_factor(df: DataFrame, level: str, x: Sequence[str], y: str, by: Sequence[str] = ()) -> tuple[G.LinearFit, DataFrame, list[float]]:
    """One fit over all rows: (fit, effects, effects of the first level)."""
    cols = [*x, y]
    total = G.gram_by_key(df, cols).get("all", G.AugGram.zeros(cols))
    train = checkpoint(level_sums(df, level, cols, by))
    between, taken = between_grams(train, cols, by).get("all", (G.AugGram.zeros(cols), 0))
    fit = fit_absorbed(total, between, taken, x, y)
    effects = level_effects(train, {"all": fit}, cols, y, by)
    return fit, effects, base_effects(effects).get("all", [0.0] * (1 + len(by)))
