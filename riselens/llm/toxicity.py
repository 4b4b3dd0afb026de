"""Toxicity by multiple-instance learning: noisy-or over sentence scores.

A sentence's score is a logistic function of its hashed words and word
beginnings; a document's is
1 - prod(1 - sentence score).  Only document labels are known, so the weights
come from the gradient of the document's log likelihood through the noisy-or,
which flows to the sentences that explain a label.  Afterwards the sentence
with the highest score, and every one of 0.5 or more, locates the offence.

The fit takes a bounded, documented sample of labelled rows (``per_class`` of
each label, those with the smallest hashes of their ids), reweighted to the
label counts of the whole table; every document is scored whole, in batches.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riselens.llm.common import clean_docs
from riselens.llm.textbuf import Words, batches, distinct

BITS = 18
PER_CLASS = 2000
FOLDS = 5
PREFIXES = (4, 5, 6)
SLICE = 1 << 20


class Model(NamedTuple):
    weights: np.ndarray
    bias: float


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo FOLDS, is 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _features(texts: list[str]) -> tuple[Words, np.ndarray, np.ndarray]:
    """Hashed features, and the word of each: the words themselves and their beginnings, which catch inflected forms."""
    words = Words(texts, lower=True, alnum=True)
    at, hashes = [np.arange(len(words.start))], [words.hash]
    for size in PREFIXES:
        where, h = words.prefix(size)
        at.append(where)
        hashes.append(h)
    return words, (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(at)


def _collect_features(frames):
    for pdf in batches(frames):
        for doc_id, toxic, text in zip(pdf["doc_id"], pdf["toxic"], pdf["text"]):
            words, feature, at = _features([text])
            sentence = words.sentence()[at]
            yield pd.DataFrame({"doc_id": [doc_id], "toxic": [toxic], "feature": [feature.astype("<i4").tobytes()], "sentence": [sentence.astype("<i4").tobytes()]})


def fit_noisy_or(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, steps: int = 250, rate: float = 0.1, min_docs: int = 3, l1: float = 5e-5) -> Model:
    """bags: per document the features of its words and the sentence of each; the list is emptied, so that its memory is free during the fit."""
    size, n = 1 << BITS, len(bags)
    seen = np.zeros(size, np.int32)
    for feature, _ in bags:
        seen[distinct(feature)] += 1
    use = seen >= min_docs
    ids, column = np.flatnonzero(use), (np.cumsum(use) - 1).astype(np.int32)
    total = sum(int(np.count_nonzero(use[f])) for f, _ in bags)
    feature, sentence = np.empty(total, np.int32), np.empty(total, np.int32)
    per_doc, at, count = np.empty(n, np.int64), 0, 0
    for d, (f, s) in enumerate(bags):
        # a sentence without a known word scores by the bias alone, and still counts
        ranks = np.unique(s, return_inverse=True)[1] if len(s) else s
        known = use[f]
        end = at + int(np.count_nonzero(known))
        feature[at:end], sentence[at:end] = column[f[known]], ranks[known] + count
        per_doc[d] = int(ranks.max()) + 1 if len(s) else 1
        at, count = end, count + int(per_doc[d])
    bags.clear()
    doc = np.repeat(np.arange(n), per_doc)
    # sums go over the sample in slices: no step makes another array of its length
    parts = [(feature[k : k + SLICE], sentence[k : k + SLICE]) for k in range(0, total, SLICE)]
    w, b = np.zeros(len(ids)), -6.0
    m, v, mass = np.zeros(len(ids) + 1), np.zeros(len(ids) + 1), weight.sum()
    for t in range(1, steps + 1):
        z = np.full(count, b)
        for f, s in parts:
            low = s.min()
            sums = np.bincount(s - low, w[f])
            z[low : low + len(sums)] += sums
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n))
        # derivative of the document's log likelihood by each sentence's z
        pull = np.where(y == 1, none / np.maximum(1 - none, 1e-12), -1.0) * weight / mass
        dz = np.minimum(p, 1 - 1e-12) * pull[doc]
        g = np.append(sum((np.bincount(f, dz[s], len(ids)) for f, s in parts), np.zeros(len(ids))), dz.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        scale = rate * (1.05 - t / steps) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        shrink = l1 * scale[:-1]
        step = scale * m / (1 - 0.9**t)
        w, b = w + step[:-1], b + step[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - shrink, 0)
    out = np.zeros(size)
    out[ids] = w
    return Model(out, float(b))


def _bags(rows: pa.Table) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Bags and labels in the order of doc_id; the arrays are views of the table's own buffers."""
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    feature, sentence = ([np.frombuffer(x.as_buffer(), "<i4") for x in rows[c]] for c in ("feature", "sentence"))
    return [(feature[k], sentence[k]) for k in order], rows["toxic"].to_numpy()[order]


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fits on at most ``per_class`` rows of each label outside the held-out fold.

    Null labels and ids are left out; an id labelled twice counts as toxic if
    any of its labels says so; without both labels the model has bias -6 only.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out("doc_id"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    rank = F.xxhash64("doc_id")
    picked = [known.where(F.col("toxic") == c).orderBy(rank, "doc_id").limit(per_class) for c in (0, 1)]
    picked = picked[0].union(picked[1])
    rows = clean_docs(docs).join(F.broadcast(picked), "doc_id").mapInPandas(_collect_features, "doc_id long, toxic int, feature binary, sentence binary")
    bags, y = _bags(rows.toArrow())
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << BITS), -6.0)
    share = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
    return fit_noisy_or(bags, y, share)


def _score(model: Model):
    weights, bias = model.weights.astype(np.float64), model.bias

    def run(frames):
        for pdf in batches(frames):
            texts = pdf["text"].tolist()
            words, feature, at = _features(texts)
            sentence = words.sentence()
            n, words_of = len(texts), np.diff(words.bounds)
            first = np.flatnonzero(np.diff(sentence, prepend=-1)) if len(sentence) else np.zeros(0, np.int64)
            rank = np.cumsum(np.diff(sentence, prepend=-1) > 0) - 1
            z = np.bincount(rank[at], weights[feature], len(first)) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            doc = words.doc[first]
            none = np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n))
            score = np.where(words_of > 0, 1 - none, 1 / (1 + np.exp(-np.clip(bias, -30, 30))))
            order = np.lexsort((-first, p, doc))
            last = np.searchsorted(doc[order], np.arange(n), "right") - 1
            top = np.where(words_of > 0, order[np.maximum(last, 0)] if len(order) else 0, -1)
            after = np.append(first[1:], len(words.start))
            base = np.concatenate(([0], words.text_end[:-1]))
            begin = [int(words.start[first[k]] - base[d]) if k >= 0 else None for d, k in enumerate(top)]
            length = [int(words.end[after[k] - 1] - words.start[first[k]]) if k >= 0 else None for k in top]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].astype("Int64"),
                "score": score,
                "n_offending": np.bincount(doc[p >= 0.5], minlength=n) if len(doc) else np.zeros(n, np.int64),
                "top_score": [float(p[k]) if k >= 0 else None for k in top],
                "top_start": pd.array(begin, "Int64"),
                "top_bytes": pd.array(length, "Int64"),
            })

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, held_out, n_offending and the worst sentence.

    The worst sentence is given by its score and its place in the UTF-8 text
    (top_start, top_bytes), the first of equals; null for texts without words,
    whose score is the bias alone.  Null texts count as empty, repeated rows are
    scored alike, an empty table stays empty, extra columns are ignored.
    """
    cols = "doc_id long, score double, n_offending long, top_score double, top_start long, top_bytes long"
    out = clean_docs(docs).mapInPandas(_score(model), cols)
    return out.withColumns({"held_out": held_out("doc_id"), "predicted": (F.col("score") >= 0.5).cast("int")})
