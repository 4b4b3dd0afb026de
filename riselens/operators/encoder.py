"""V4: dense vectors for every title, from hashed TF-IDF and a randomised SVD on Spark.

Terms (words and word pairs) fall into a fixed number of buckets, so the encoder
has the same size for any corpus: idf weights and a (buckets × dim) matrix of
right singular vectors.  Fitting takes one aggregate for the document counts and
a pass per round of subspace iteration, X'(XQ) summed over partitions in row
blocks; only (buckets × dim)-sized sums reach the driver.  Encoding is a
projection of each title's sparse row, so every title has a vector (a title
without terms the zero vector).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riselens.operators import gram as G
from riselens.operators.textvec import WORD_PATTERN

BLOCKS = 16  # of rows of a partial sum, which are reduced on their own
#: Terms worked off together (or one longer title): each takes a row of the basis, several times over.
PIECE = 1 << 16


@dataclass
class Encoder:
    idf: np.ndarray       # per bucket
    vectors: np.ndarray   # (buckets, dim): right singular vectors
    singular: np.ndarray  # singular values


def buckets_of(text: str, buckets: int) -> Column:
    """The bucket of every word and every pair of neighbouring words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD_PATTERN), F.lit(0))
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    terms = F.concat(words, F.filter(pairs, lambda p: p.isNotNull()))
    return F.transform(terms, lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int"))


def _sparse(rows: pd.Series, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, buckets and weights (L2-normalised counts x idf) of a batch."""
    size = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate([np.asarray(r, np.int64) for r in rows]) if size.sum() else np.zeros(0, np.int64)
    key, tf = np.unique(np.repeat(np.arange(len(size)), size) * len(idf) + flat, return_counts=True)
    row, bucket = key // len(idf), key % len(idf)
    w = tf * idf[bucket]
    norm = np.sqrt(np.bincount(row, w * w, len(size)))
    return row, bucket, w / np.where(norm > 0, norm, 1.0)[row]


def _pieces(rows: pd.Series) -> Iterable[pd.Series]:
    """A batch in runs of titles of about PIECE terms, so that memory depends neither on its rows nor on their length."""
    ends = np.cumsum([len(r) for r in rows])
    at = np.unique(ends // PIECE, return_index=True)[1]
    for a, b in zip(at, [*at[1:], len(rows)]):
        yield rows.iloc[a:b]


def _times(rows: pd.Series, idf: np.ndarray, Q: np.ndarray) -> tuple[np.ndarray, tuple]:
    """X Q of a batch, and its sparse entries."""
    row, bucket, w = _sparse(rows, idf)
    out = np.zeros((len(rows), Q.shape[1]))
    if len(row):
        first = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[first]] = np.add.reduceat(Q[bucket] * w[:, None], first, axis=0)
    return out, (row, bucket, w)


def fit_encoder(df: DataFrame, text: str = "title", dim: int = 64, buckets: int = 4096, rounds: int = 3, extra: int = 16, seed: int = 0) -> Encoder:
    """An encoder of ``dim`` components from all titles; an empty table gives zero vectors."""
    src = df.select(buckets_of(text, buckets).alias("b"))
    counts = src.select(F.explode(F.array_distinct("b")).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()  # <= buckets rows
    n = src.count()
    seen = np.zeros(buckets)
    for r in counts:
        seen[r["b"]] = r["n"]
    idf = np.log((1 + n) / (1 + seen)) + 1
    width = min(dim + extra, buckets)
    Q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(buckets, width)))
    cuts = np.linspace(0, buckets, BLOCKS + 1).astype(int)

    def passed(Q: np.ndarray) -> np.ndarray:
        def partials(batches: Iterable[pd.DataFrame]):
            total = np.zeros(Q.shape)
            for pdf in batches:
                for rows in _pieces(pdf["b"]):
                    Y, (row, bucket, w) = _times(rows, idf, Q)
                    order = np.argsort(bucket, kind="stable")
                    first = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                    if len(first):
                        total[bucket[order][first]] += np.add.reduceat(Y[row[order]] * w[order, None], first, axis=0)
            yield from G.partial_frames({str(i): total[a:b].ravel() for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))})

        sums = G.reduce_partials(src.mapInPandas(partials, G.PARTIAL_SCHEMA))
        empty = np.zeros(0)
        return np.concatenate([sums.get(str(i), empty) if str(i) in sums else np.zeros((b - a) * Q.shape[1]) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]).reshape(Q.shape)

    for _ in range(rounds):
        Q, _ = np.linalg.qr(passed(Q))
    small = Q.T @ passed(Q)  # Q'X'XQ
    values, axes = np.linalg.eigh((small + small.T) / 2)
    top = np.argsort(values)[::-1][:dim]
    V = Q @ axes[:, top]
    V *= np.where(V[np.abs(V).argmax(axis=0), np.arange(V.shape[1])] < 0, -1.0, 1.0)  # signs: the largest entry is positive
    return Encoder(idf, V, np.sqrt(np.clip(values[top], 0, None)))


def encode(df: DataFrame, encoder: Encoder, text: str = "title", out: str = "vector") -> DataFrame:
    """All rows with ``out``, the vector of their title; null and empty titles have the zero vector."""
    buckets = len(encoder.idf)

    @F.pandas_udf("array<double>")
    def project(rows: pd.Series) -> pd.Series:
        found = [v for some in _pieces(rows) for v in _times(some, encoder.idf, encoder.vectors)[0]]
        return pd.Series(found, dtype=object)

    return df.withColumn(out, project(buckets_of(text, buckets)))
