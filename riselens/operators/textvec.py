"""Text vectors (V1–V11): TF-IDF, SVD, PCA, scaling and linear models on vectors.

* V1 TF-IDF is relational: terms (words of two or more word characters and
  their bigrams) are exploded per title, document frequencies aggregated, the
  vocabulary (at most ``max_features`` terms — a proven bound, so it is
  broadcast) joined back; weights ``tf·(ln((1+n)/(1+df))+1)`` are L2
  normalised per title.
* V2/V5/V6: the vector Gram (one ``mapInPandas`` pass, dense numpy per batch)
  gives SVD components (eigenvectors of XᵀX), PCA (of the centered Gram) and
  scaler moments; projections are linear maps of the Gram, so no data pass
  is repeated per variant.
* V7: ridge alpha chosen by exact leave-one-out error — one pass computing
  every row's leverage for every alpha from a broadcast eigenbasis.
* V4 title vectors are an input table (``post_id, embedding array<float>``)
  joined to the posts.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riselens.operators import gram as G

WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"


def term_counts(df: DataFrame, text: str = "title", key: str = "post_id", ngram_max: int = 2) -> DataFrame:
    """(key, term, tf): lower-cased word terms and n-grams up to ``ngram_max``."""
    toks = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD_PATTERN), F.lit(0))
    base = df.select(F.col(key), toks.alias("_t"))
    for k in range(1, ngram_max):
        base = base.withColumn(f"_n{k}", F.slice("_t", k + 1, F.greatest(F.size("_t") - k, F.lit(0))))
    grams = [F.col("_t")]
    for n in range(2, ngram_max + 1):
        z = F.arrays_zip("_t", *[f"_n{k}" for k in range(1, n)])
        full = F.filter(z, _not_null(f"_n{n - 1}"))
        grams.append(F.transform(full, _joiner(n)))
    terms = base.select(F.col(key), F.explode(F.flatten(F.array(*grams))).alias("term"))
    return terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def _not_null(field: str):
    return lambda e: e[field].isNotNull()


def _joiner(n: int):
    return lambda e: F.concat_ws(" ", e["_t"], *[e[f"_n{k}"] for k in range(1, n)])


def fit_tfidf(counts: DataFrame, n_docs: int, max_features: int = 500, min_df: int = 5) -> DataFrame:
    """Vocabulary (term, idx, idf): df >= min_df, top ``max_features`` by corpus
    frequency (ties by term), smoothed idf ln((1+n)/(1+df)) + 1 with n the
    number of fitted documents (including those without terms)."""
    stats = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    top = stats.filter(F.col("df") >= min_df).orderBy(F.col("cf").desc(), F.col("term")).limit(max_features)
    rows = top.collect()                                        # <= max_features rows
    spark = counts.sparkSession
    vocab = sorted(r["term"] for r in rows)
    idf = {r["term"]: float(np.log((1 + n_docs) / (1 + r["df"])) + 1.0) for r in rows}
    return spark.createDataFrame([(t, i, idf[t]) for i, t in enumerate(vocab)], "term string, idx int, idf double")


def transform_tfidf(counts: DataFrame, vocab: DataFrame, key: str = "post_id") -> DataFrame:
    """(key, idx, term, tfidf) with rows L2-normalised (vocab broadcast: bounded)."""
    w = counts.join(F.broadcast(vocab), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    return w.join(norms, key).select(key, "idx", "term", (F.col("w") / F.col("_norm")).alias("tfidf"))


def dense_vectors(long: DataFrame, dim: int, key: str = "post_id", idx: str = "idx", value: str = "tfidf",
                  out: str = "vector") -> DataFrame:
    """Sparse long form -> dense array per key (a row's entries are bounded by its text)."""
    per = long.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col(idx), F.col(value)))).alias("_m"))
    return per.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                                       lambda i: F.coalesce(F.col("_m")[i], F.lit(0.0))).alias(out))


def title_vectors(posts: DataFrame, vectors: DataFrame, key: str = "post_id", vec: str = "embedding") -> DataFrame:
    """V4: attach the vector table (inner join: posts without a vector drop)."""
    return posts.join(vectors.select(F.col(key).cast("string").alias(key), F.col(vec).alias("vector")), key)


# ---------------------------------------------------------------------------
# Vector Grams and linear maps
# ---------------------------------------------------------------------------

def vector_gram(df: DataFrame, dim: int, extra: Sequence[str] = (), key: Column | str | None = None,
                vec: str = "vector") -> dict[str, G.AugGram]:
    """Augmented Gram per key over [v_0 … v_{dim-1}, extra…]."""
    names = [f"v{i}" for i in range(dim)] + list(extra)
    k = len(names) + 1
    kcol = F.lit("all") if key is None else (F.col(key) if isinstance(key, str) else key)
    src = df.select(kcol.cast("string").alias("_k"), F.col(vec).cast("array<double>").alias("_v"),
                    *[G.filled(c, f"_e{i}") for i, c in enumerate(extra)])
    src = src.filter(F.col("_k").isNotNull() & F.col("_v").isNotNull())

    def partials(batches: Iterable[pd.DataFrame]):
        acc: dict[str, np.ndarray] = {}
        for pdf in batches:
            for kv, g in pdf.groupby("_k", sort=False):
                X = np.empty((len(g), k))
                X[:, 0] = 1.0
                X[:, 1:dim + 1] = np.stack(g["_v"].to_numpy())
                for i in range(len(extra)):
                    X[:, dim + 1 + i] = g[f"_e{i}"].to_numpy(dtype=np.float64)
                acc[kv] = acc.get(kv, 0) + X.T @ X
        yield from G.partial_frames({name: m.ravel() for name, m in acc.items()})

    found = G.reduce_partials(src.mapInPandas(partials, G.PARTIAL_SCHEMA))
    return {name: G.AugGram(names, flat.reshape(k, k)) for name, flat in found.items()}


def svd_components(g: G.AugGram, dim: int, k: int) -> np.ndarray:
    """V2: top-k right singular vectors of X (uncentered), rows = components."""
    ix = g.idx([f"v{i}" for i in range(dim)])
    evals, evecs = np.linalg.eigh(g.U[np.ix_(ix, ix)])
    order = np.argsort(evals)[::-1][:k]
    return evecs[:, order].T


def pca_components(g: G.AugGram, dim: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """V5: mean and top-k principal axes of the centered Gram (fit on train)."""
    names = [f"v{i}" for i in range(dim)]
    n, mx, _, sxx, _, _ = g.block(names, names[0])
    evals, evecs = np.linalg.eigh(sxx)
    order = np.argsort(evals)[::-1][:k]
    return mx, evecs[:, order].T


def project(g: G.AugGram, dim: int, comps: np.ndarray, mean: np.ndarray | None = None,
            prefix: str = "c") -> G.AugGram:
    """Gram of z = comps·(v − mean) (other columns kept): a linear map of U."""
    vn = [f"v{i}" for i in range(dim)]
    iv = g.idx(vn)
    others = [c for c in g.names if c not in vn]
    io = g.idx(others)
    k = comps.shape[0]
    M = np.zeros((1 + k + len(others), g.U.shape[0]))
    M[0, 0] = 1.0
    for r in range(k):
        M[1 + r, iv] = comps[r]
        if mean is not None:
            M[1 + r, 0] = -float(comps[r] @ mean)
    for j, i in enumerate(io):
        M[1 + k + j, i] = 1.0
    return g.linear([f"{prefix}{r}" for r in range(k)] + others, M)


def weights_on_vector(fit: G.LinearFit, dim: int, comps: np.ndarray | None, mean: np.ndarray | None,
                      scale: np.ndarray | None) -> tuple[np.ndarray, float]:
    """Collapse scaler ∘ projection ∘ linear model into (w over v, intercept)."""
    beta = np.asarray(fit.coef, dtype=float)
    b0 = float(fit.intercept)
    if scale is not None:
        smean, sstd = scale
        beta = beta / sstd
        b0 -= float(beta @ smean)
    if comps is None:
        return beta, b0
    w = comps.T @ beta
    if mean is not None:
        b0 -= float(w @ mean)
    return w, b0


def vector_predict_expr(w: np.ndarray, b0: float, vec: str = "vector") -> Column:
    """Prediction as one expression: b0 + Σ w_i v_i (literals, no UDF)."""
    lits = F.array(*[F.lit(float(x)) for x in w])
    prod = F.zip_with(F.col(vec).cast("array<double>"), lits, lambda a, b: a * b)
    return F.lit(b0) + F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + x)


def ridge_loo(df: DataFrame, designs: Sequence[tuple[G.AugGram, Sequence[str], np.ndarray, np.ndarray]], y: str,
              alphas: Sequence[float], vec: str = "vector") -> list[tuple[float, np.ndarray]]:
    """V7: the exact leave-one-out error of ridge for every alpha, all designs in one pass over the training rows.

    A design is the Gram of its columns over the same rows, the columns, and
    the linear map (M, c) from a row's vector to them: z = M·v + c.  With the
    eigenbasis Q, Λ of the centred scatter, ŷ(α) = ȳ + zᵀQ (Λ+α)⁻¹ Qᵀ Zᵀy and the
    leverage is 1/n + zᵀQ (Λ+α)⁻¹ Qᵀz; a row's error when left out is
    (y − ŷ)/(1 − h).  Returns the best alpha and all errors of each design.
    """
    A = np.asarray(alphas, dtype=float)
    solved = []
    for g, x, M, c in designs:
        n, mx, my, sxx, sxy, _ = g.block(x, y)
        lam, Q = np.linalg.eigh(sxx)
        solved.append((n, my, np.clip(lam, 0, None), Q.T @ sxy, Q.T @ M, Q.T @ (c - mx)))
    src = df.select(F.col(vec).cast("array<double>").alias("_v"), F.col(y).cast("double").alias("_y"))

    def part(batches):
        tot = np.zeros((len(solved), len(A)))
        for pdf in batches:
            if pdf.empty:
                continue
            V, yy = np.stack(pdf["_v"].to_numpy()), pdf["_y"].to_numpy(dtype=np.float64)
            for d, (n, my, lam, proj_y, M, c) in enumerate(solved):
                P = V @ M.T + c
                inv = 1.0 / (lam[None, :] + A[:, None])
                yhat = my + (P * proj_y[None, :]) @ inv.T
                h = 1.0 / n + (P * P) @ inv.T
                tot[d] += (((yy[:, None] - yhat) / (1.0 - h)) ** 2).sum(axis=0)
        yield from G.partial_frames({"all": tot.ravel()})

    sums = G.reduce_partials(src.mapInPandas(part, G.PARTIAL_SCHEMA)).get("all", np.zeros(len(solved) * len(A)))
    out = []
    for (n, *_), tot in zip(solved, sums.reshape(len(solved), len(A))):
        mse = tot / max(n, 1.0)
        out.append((float(A[int(np.argmin(mse))]), mse))
    return out


def write_predictions(df: DataFrame, path: str, config: str, actual: str, pred: str, time: str = "created_dt") -> None:
    """One partition of the prediction table per configuration (id, community, time, actual, predicted); written again, it is replaced."""
    rows = df.select("post_id", "subreddit", F.col(time).alias("created_dt"), F.col(actual).cast("double").alias("actual"), F.col(pred).cast("double").alias("predicted"))
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/config={config}")


def read_predictions(spark, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path)
