"""Sufficient statistics on Spark, small solves on the driver.

Every linear model of the pipeline — OLS, ridge, elastic net, each CV fold,
temporal split, daily block, bootstrap replicate and learning-curve prefix —
needs only the augmented Gram matrix ``U = Σ w·u·uᵀ`` with
``u = [1, x_1 … x_p, y]`` of its rows.  ``gram_by_key`` computes ``U`` for many
row groups in one pass: each partition builds numpy partials per key
(``mapInPandas``), partials are summed in a salted two-level reduction (no
single task receives every partition's partial), and only the p×p matrices
reach the driver.  Splits, folds and prefixes are then sums and differences of
these matrices; transformed targets (a Stage A residual) are linear maps
``M U Mᵀ``.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = 64
#: A column whose centred sum of squares is below this share of its raw one is constant:
#: rounding leaves about 1e-15 of it, whatever the constant and the scale.
CONSTANT = 1e-12
#: Least eigenvalue of a correlation matrix, per column, that counts for the rank.
RANK_TOL = 1e-10


@dataclass
class AugGram:
    """Augmented Gram over u = [1, v_1 … v_k] with named columns of v."""

    names: list[str]
    U: np.ndarray

    @property
    def n(self) -> float:
        return float(self.U[0, 0])

    def __add__(self, other: AugGram) -> AugGram:
        return AugGram(self.names, self.U + other.U)

    def __sub__(self, other: AugGram) -> AugGram:
        return AugGram(self.names, self.U - other.U)

    @staticmethod
    def zeros(names: Sequence[str]) -> AugGram:
        k = len(names) + 1
        return AugGram(list(names), np.zeros((k, k)))

    def idx(self, cols: Sequence[str]) -> list[int]:
        pos = {c: i + 1 for i, c in enumerate(self.names)}
        return [pos[c] for c in cols]

    def linear(self, out_names: Sequence[str], M: np.ndarray) -> AugGram:
        """Gram of new columns z = M @ u (M has one row per output, incl. the
        leading constant row [1, 0 …])."""
        return AugGram(list(out_names), M @ self.U @ M.T)

    def block(self, x: Sequence[str], y: str):
        """(n, mean_x, mean_y, Sxx, Sxy, Syy) centered sums for x and y."""
        ix, iy = self.idx(x), self.idx([y])[0]
        n = self.n
        sx = self.U[0, ix]
        sy = self.U[0, iy]
        mx = sx / n if n else np.zeros(len(ix))
        my = sy / n if n else 0.0
        sxx = self.U[np.ix_(ix, ix)] - n * np.outer(mx, mx)
        sxy = self.U[ix, iy] - n * mx * my
        syy = self.U[iy, iy] - n * my * my
        return n, mx, my, sxx, sxy, syy


# ---------------------------------------------------------------------------
# Wide projections as SQL text: one JVM call per column instead of one per
# expression node (designs have hundreds of columns).
# ---------------------------------------------------------------------------

def sql_name(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def sql_lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, (bool, np.bool_)):
        return "true" if v else "false"
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    if isinstance(v, (float, np.floating)):
        f = float(v)
        return repr(f) + "D" if math.isfinite(f) else f"CAST('{f}' AS DOUBLE)"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def filled_sql(c: str) -> str:
    """``c`` as double, null -> 0 (SQL text)."""
    return f"coalesce(CAST({sql_name(c)} AS DOUBLE), 0.0D)"


def filled(c: str, alias: str) -> Column:
    return F.expr(f"{filled_sql(c)} AS {sql_name(alias)}")


def indicator(src: str, level) -> Column:
    """1.0 where ``src`` equals ``level`` (null where ``src`` is null)."""
    return F.expr(f"CAST({sql_name(src)} = {sql_lit(level)} AS DOUBLE)")


# ---------------------------------------------------------------------------
# Spark side: one pass, any number of keys
# ---------------------------------------------------------------------------

def gram_by_key(df: DataFrame, cols: Sequence[str], key: Column | str | None = None,
                weight: Column | str | None = None) -> dict[str, AugGram]:
    """Augmented Gram per key value (string) over ``cols`` (nulls -> 0).

    The key may be any column expression; rows with a null key are skipped.
    """
    names = list(cols)
    k = len(names) + 1
    kcol = F.lit("all") if key is None else (F.col(key) if isinstance(key, str) else key)
    wcol = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    src = df.select(kcol.cast("string").alias("_k"), wcol.cast("double").alias("_w"),
                    *[filled(c, f"_x{i}") for i, c in enumerate(names)])
    src = src.filter(F.col("_k").isNotNull() & (F.col("_w") != 0))
    xcols = [f"_x{i}" for i in range(len(names))]

    def partials(batches: Iterable[pd.DataFrame]):
        acc: dict[str, np.ndarray] = {}
        for pdf in batches:
            if pdf.empty:
                continue
            for kv, g in pdf.groupby("_k", sort=False):
                X = np.empty((len(g), k))
                X[:, 0] = 1.0
                X[:, 1:] = g[xcols].to_numpy(dtype=np.float64)
                w = g["_w"].to_numpy(dtype=np.float64)
                part = (X * w[:, None]).T @ X
                acc[kv] = acc[kv] + part if kv in acc else part
        yield from partial_frames({name: m.ravel() for name, m in acc.items()})

    found = reduce_partials(src.mapInPandas(partials, PARTIAL_SCHEMA))
    return {name: AugGram(names, flat.reshape(k, k)) for name, flat in found.items()}


PARTIAL_SCHEMA = "_k string, _salt int, _u binary"


def partial_frames(acc: dict[str, np.ndarray]) -> Iterable[pd.DataFrame]:
    """A task's flat partial sums by key, as rows of PARTIAL_SCHEMA."""
    if acc:
        # Deterministic salt (partition id): a retried task writes the same rows.
        ctx = TaskContext.get()
        salt = (ctx.partitionId() if ctx is not None else 0) % SALT
        yield pd.DataFrame({"_k": list(acc), "_salt": salt, "_u": [m.tobytes() for m in acc.values()]})


def reduce_partials(partials: DataFrame) -> dict[str, np.ndarray]:
    """Sums of the partials per key, in two levels: no task gets the partials of all tasks."""

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        tot = np.frombuffer(pdf["_u"].iloc[0], dtype=np.float64).copy()
        for b in pdf["_u"].iloc[1:]:
            tot += np.frombuffer(b, dtype=np.float64)
        return pd.DataFrame({"_k": [pdf["_k"].iloc[0]], "_salt": [0], "_u": [tot.tobytes()]})

    level = partials.groupBy("_k", "_salt").applyInPandas(reduce, PARTIAL_SCHEMA)
    final = level.groupBy("_k").applyInPandas(reduce, PARTIAL_SCHEMA)
    return {r["_k"]: np.frombuffer(r["_u"], dtype=np.float64).copy() for r in final.collect()}


def sum_grams(grams: Iterable[AugGram], names: Sequence[str]) -> AugGram:
    tot = AugGram.zeros(names)
    for g in grams:
        tot = tot + g
    return tot


# ---------------------------------------------------------------------------
# Driver side: solvers on centered sums
# ---------------------------------------------------------------------------

@dataclass
class LinearFit:
    features: list[str]
    coef: np.ndarray
    intercept: float
    n: float
    extra: dict

    def predict_expr(self, prefix: str = "") -> Column:
        """Prediction as one Spark expression (coefficients as literals)."""
        terms = [sql_lit(float(self.intercept))]
        terms += [f"{filled_sql(prefix + c)} * {sql_lit(float(b))}"
                  for c, b in zip(self.features, self.coef) if b != 0.0]
        return F.expr(" + ".join(terms))

    def table(self) -> pd.DataFrame:
        d = {"feature": self.features, "coef": self.coef}
        for k in ("std_err", "t_value"):
            if k in self.extra:
                d[k] = self.extra[k]
        return pd.DataFrame(d)


def fit_ols(g: AugGram, x: Sequence[str], y: str, rcond: float = 1e-12) -> LinearFit:
    """OLS with intercept via the pseudo-inverse of the correlation matrix,
    scaled back, so regressors of any scale count alike; standard errors from
    it.  On a singular design the slope has the least norm in units of the
    regressors' standard deviations; a constant column gets 0 and no rank."""
    n, mx, my, sxx, sxy, syy = g.block(x, y)
    raw = np.diag(g.U)[g.idx(x)]
    diag = np.clip(np.diag(sxx), 0, None)
    varies = diag > CONSTANT * raw  # a constant leaves a rounding residue of its raw square
    unit = np.sqrt(np.where(varies, diag, 1.0))
    corr = np.where(np.outer(varies, varies), sxx / np.outer(unit, unit), 0.0)
    pinv = np.linalg.pinv(corr, rcond=rcond, hermitian=True) / np.outer(unit, unit)
    beta = np.where(varies, pinv @ sxy, 0.0)
    b0 = my - mx @ beta
    rss = max(float(syy - 2 * beta @ sxy + beta @ sxx @ beta), 0.0)
    rank = int(np.linalg.matrix_rank(corr, tol=RANK_TOL * max(1, len(x)), hermitian=True)) if len(x) else 0
    dof = n - rank - 1
    sigma2 = rss / dof if dof > 0 else float("nan")
    se = np.sqrt(np.clip(np.diag(pinv) * sigma2, 0, None))
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(se > 0, beta / se, np.nan)
    return LinearFit(list(x), beta, float(b0), n, {"std_err": se, "t_value": t, "rss": rss, "rank": rank,
                                                 "sigma2": sigma2})


def fit_ridge(g: AugGram, x: Sequence[str], y: str, alpha: float) -> LinearFit:
    """Ridge with unpenalised intercept: (Sxx + αI)β = Sxy."""
    n, mx, my, sxx, sxy, _ = g.block(x, y)
    beta = np.linalg.solve(sxx + alpha * np.eye(len(x)), sxy)
    return LinearFit(list(x), beta, float(my - mx @ beta), n, {"alpha": alpha})


def fit_ridge_gcv(g: AugGram, x: Sequence[str], y: str, alphas: Sequence[float]) -> LinearFit:
    """Ridge with alpha chosen by generalised cross-validation, from the
    eigen-decomposition of the centered Gram; ``textvec.ridge_loo`` is exact."""
    n, mx, my, sxx, sxy, syy = g.block(x, y)
    evals, evecs = np.linalg.eigh(sxx)
    evals = np.clip(evals, 0, None)
    proj = evecs.T @ sxy
    best = None
    for a in alphas:
        beta = evecs @ (proj / (evals + a))
        rss = float(syy - 2 * beta @ sxy + beta @ sxx @ beta)
        df_ = float(np.sum(evals / (evals + a))) + 1.0
        gcv = rss / n / (1 - df_ / n) ** 2 if n > df_ else float("inf")
        if best is None or gcv < best[0]:
            best = (gcv, a, beta)
    _, a, beta = best
    return LinearFit(list(x), beta, float(my - mx @ beta), n, {"alpha": a, "gcv": best[0]})


def fit_elastic_net(g: AugGram, x: Sequence[str], y: str, alpha: float, l1_ratio: float, **kw) -> LinearFit:
    n, mx, my, sxx, sxy, _ = g.block(x, y)
    beta = _enet_active_set(sxx, sxy, n, alpha, l1_ratio)
    return LinearFit(list(x), beta, float(my - mx @ beta), n, {"alpha": alpha, "l1_ratio": l1_ratio})


def alpha_grid(g: AugGram, x: Sequence[str], y: str, l1_ratio: float, n_alphas: int = 100, eps: float = 1e-3) -> np.ndarray:
    """Default path, αmax = max|Xᵀy|/(n·l1) on centered data, down to eps·αmax."""
    n, _, _, _, sxy, _ = g.block(x, y)
    amax = float(np.max(np.abs(sxy))) / (n * max(l1_ratio, 1e-3)) if len(sxy) else 1.0
    amax = amax if amax > 0 else 1.0
    return np.logspace(np.log10(amax), np.log10(amax * eps), n_alphas)


def sse(g: AugGram, fit: LinearFit, y: str) -> float:
    """Σ (y − ŷ)² on the rows of ``g`` for a fitted model (no data pass)."""
    ix, iy = g.idx(fit.features), g.idx([y])[0]
    c = np.zeros(g.U.shape[0])
    c[0] = -fit.intercept
    c[ix] = -fit.coef
    c[iy] += 1.0
    return float(max(c @ g.U @ c, 0.0))


def metrics(g: AugGram, fit: LinearFit, y: str) -> dict:
    """E1 from sufficient statistics: RMSE, R² (centered), n."""
    n = g.n
    if n <= 0:
        return {"rmse": None, "r2": None, "n": 0}
    e2 = sse(g, fit, y)
    _, _, _, _, _, syy = g.block([], y)
    return {"rmse": float(np.sqrt(e2 / n)), "r2": float(1 - e2 / syy) if syy > 0 else None, "n": int(round(n))}


def _enet_active_set(Q: np.ndarray, q: np.ndarray, n: float, alpha: float, l1: float,
                     w0: np.ndarray | None = None, max_iter: int = 500) -> np.ndarray:
    """Exact elastic net by feature-sign (active-set) search.

    Minimises ½wᵀHw − cᵀw + λ‖w‖₁ with H = Q/n + α(1−l1)I, c = q/n,
    λ = α·l1 (the same objective as the coordinate descent).  Each step
    solves the system on the active set with the current signs and does a
    discrete line search over sign changes; optimality is checked with the
    KKT conditions.  Converges in a few small solves.
    """
    p = len(q)
    if p == 0 or n <= 0:
        return np.zeros(p)
    lam = alpha * l1
    H = Q / n + alpha * (1 - l1) * np.eye(p)
    c = q / n
    w = np.zeros(p) if w0 is None else w0.copy()
    theta = np.sign(w)
    eps = 1e-12 * max(1.0, float(np.max(np.abs(c))))

    def obj(v):
        return 0.5 * v @ H @ v - c @ v + lam * np.abs(v).sum()

    for _ in range(max_iter):
        g = H @ w - c
        zero = theta == 0
        # 1. activate the most violating zero coefficient
        viol = np.where(zero, np.abs(g) - lam, -np.inf)
        nz_opt = np.all(np.abs(g[~zero] + lam * theta[~zero]) <= 1e-10 * max(1.0, lam)) if (~zero).any() else True
        if nz_opt:
            i = int(np.argmax(viol))
            if viol[i] <= eps:
                break
            theta[i] = -np.sign(g[i])
        # 2. feature-sign step on the active set
        A = np.nonzero(theta)[0]
        HA = H[np.ix_(A, A)]
        rhs = c[A] - lam * theta[A]
        try:
            wn = np.linalg.solve(HA, rhs)
        except np.linalg.LinAlgError:
            wn = np.linalg.lstsq(HA, rhs, rcond=None)[0]
        wa = w[A]
        # candidate points: the new solution and every sign-change crossing
        cands = [wn]
        d = wn - wa
        cross = (np.sign(wn) != np.sign(wa)) & (wa != 0)
        for j in np.nonzero(cross)[0]:
            t = -wa[j] / d[j]
            if 0 < t < 1:
                pt = wa + t * d
                pt[j] = 0.0
                cands.append(pt)
        best_v, best_o = None, np.inf
        for cand in cands:
            full = np.zeros(p)
            full[A] = cand
            o = obj(full)
            if o < best_o:
                best_v, best_o = full, o
        w = best_v
        w[np.abs(w) < 1e-15] = 0.0
        theta = np.sign(w)
    return w


def _sse_batch(g: AugGram, x: Sequence[str], y: str, intercepts: np.ndarray, betas: np.ndarray) -> np.ndarray:
    """Σ(y − b − Xβ)² on g's rows for many (intercept, beta) pairs."""
    ix, iy = g.idx(x), g.idx([y])[0]
    k = g.U.shape[0]
    C = np.zeros((len(intercepts), k))
    C[:, 0] = -intercepts
    C[:, ix] = -betas
    C[:, iy] += 1.0
    return np.clip(np.einsum("ak,kl,al->a", C, g.U, C), 0, None)


def fit_elastic_net_cv(train_folds: Sequence[AugGram], x: Sequence[str], y: str, l1_ratios: Sequence[float],
                       alphas: Sequence[float] | None = None, **kw) -> tuple[LinearFit, dict]:
    """M9: k-fold search over l1_ratio × alpha from fold Grams.

    For fold f the model is fitted on (total − fold f) and scored on fold f;
    the (l1, alpha) with the smallest mean validation MSE is refitted on all
    folds (folds given, intercept refitted per fold, as in the studied CV).
    """
    total = sum_grams(train_folds, train_folds[0].names)
    trains = [total - f for f in train_folds]
    blocks = [t.block(x, y) for t in trains]
    n = np.array([b[0] for b in blocks])
    mx = np.stack([b[1] for b in blocks])
    my = np.array([b[2] for b in blocks])
    sxx = np.stack([b[3] for b in blocks])
    sxy = np.stack([b[4] for b in blocks])
    syy = np.array([b[5] for b in blocks])
    best = None
    path_results = []
    for l1 in l1_ratios:
        grid = np.sort(np.asarray(alphas if alphas is not None else alpha_grid(total, x, y, l1), dtype=float))[::-1]
        mses = np.zeros(len(grid))
        for f, fold in enumerate(train_folds):
            betas, warm = [], None
            for a in grid:                      # pathwise warm start, large -> small alpha
                warm = _enet_active_set(sxx[f], sxy[f], n[f], float(a), float(l1), warm)
                betas.append(warm)
            betas = np.array(betas)
            b0 = my[f] - betas @ mx[f]
            mses += _sse_batch(fold, x, y, b0, betas) / max(fold.n, 1.0)
        mses /= len(train_folds)
        for a, m in zip(grid, mses):
            path_results.append({"l1_ratio": float(l1), "alpha": float(a), "cv_mse": float(m)})
            if best is None or m < best[0]:
                best = (float(m), float(l1), float(a))
    _, l1, a = best
    fit = fit_elastic_net(total, x, y, a, l1, **kw)
    return fit, {"l1_ratio": l1, "alpha": a, "cv_mse": best[0], "path": path_results}


def scaler_from_gram(g: AugGram, x: Sequence[str], ddof: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """M8: means and standard deviations (ddof 0 like StandardScaler); zero
    std -> 1 (column passes through)."""
    n = g.n
    ix = g.idx(x)
    mean = g.U[0, ix] / n
    var = np.diag(g.U)[ix] / n - mean ** 2
    var = np.clip(var, 0, None) * (n / (n - ddof) if n > ddof else 1.0)
    std = np.sqrt(var)
    return mean, np.where(std > 0, std, 1.0)


def standardize(g: AugGram, x: Sequence[str], mean: np.ndarray, std: np.ndarray, center: bool = True) -> AugGram:
    """Gram of (x − mean)/std (or x/std), other columns unchanged."""
    k = g.U.shape[0]
    M = np.eye(k)
    for j, i in enumerate(g.idx(x)):
        M[i, :] = 0.0
        M[i, i] = 1.0 / std[j]
        if center:
            M[i, 0] = -mean[j] / std[j]
    return g.linear(g.names, M)


def residual_gram(g: AugGram, fit: LinearFit, y: str, out: str = "_resid") -> AugGram:
    """Append the residual y − ŷ of a fitted model as a new column."""
    k = g.U.shape[0]
    c = np.zeros(k)
    c[0] = -fit.intercept
    c[g.idx(fit.features)] = -fit.coef
    c[g.idx([y])[0]] += 1.0
    M = np.vstack([np.eye(k), c[None, :]])
    return g.linear(g.names + [out], M)
