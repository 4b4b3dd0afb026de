"""The randomised SVD of decontamination against plain matrix products, and the work it takes."""

import random
import tracemalloc

import numpy as np
import pandas as pd

from riselens.llm import decontamination as D
from riselens.llm.textbuf import Words


def _matrix(rows, idf, column, width):
    """The TF-IDF matrix entry by entry: rows of WINDOW words of length ``weight``."""
    out = []
    for text, weight in rows:
        terms = D._dims(Words([text], lower=True, alnum=True).hash)
        for lo in range(0, len(terms), D.WINDOW):
            t = terms[lo:lo + D.WINDOW]
            line = np.zeros(width)
            for x in t:
                if column[x] >= 0:
                    line[column[x]] += idf[x] * weight / np.sqrt((idf[t] ** 2).sum())
            out.append(line)
    return np.array(out)


def _case(n=90):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(" ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 7, 48, 49, 150]))), rng.choice([0.3, 1.0, 16.0])) for _ in range(n)]
    rows += [("", 1.0), ("unknown words only", 2.0), ("w1 w1 w1 w2", 1.0)]
    idf = np.random.default_rng(3).uniform(0.5, 6.0, 1 << D.BITS)
    column = np.full(1 << D.BITS, -1, np.int32)
    known = np.unique(D._dims(Words([" ".join(vocabulary[:40])]).hash))
    column[known] = np.arange(len(known))
    return rows, idf, column, len(known)


def test_basis_equals_plain_subspace_iteration(spark):
    rows, idf, column, width = _case()
    a = _matrix(rows, idf, column, width)
    q = np.random.Generator(np.random.PCG64(7)).standard_normal((width, 8)).astype(np.float32)
    for _ in range(2):
        q = np.linalg.qr(a.T @ (a @ q.astype(np.float64)))[0]
    got = D.randomised_svd(spark.createDataFrame(rows, "text string, weight double").repartition(3), idf, column, width, 8)
    assert got.shape == (width, 8)
    assert np.abs(got @ got.T - q @ q.T).max() < 1e-3


def test_products_take_a_block_of_rows_at_a_time():
    """Long texts need no row of ``rank`` numbers for each of their words."""
    rng = np.random.default_rng(5)
    width, rank, rows = 300, 64, 1000
    row, col = np.sort(rng.integers(0, rows, 40_000)), rng.integers(0, width, 40_000)
    scale, q = rng.random((rows, 1), np.float32), rng.random((width, rank), np.float32)
    total = np.zeros((width, rank), np.float32)
    tracemalloc.start()
    D._add_products(total, row, col, scale, q)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    counts = np.zeros((rows, width))
    np.add.at(counts, (row, col), 1.0)
    want = counts.T @ (counts @ q * scale)
    assert np.allclose(total, want, rtol=1e-4)
    assert peak < 40_000 * rank * 4 / 4


def test_project_sums_the_rows_of_known_words():
    rng = np.random.default_rng(2)
    column = np.where(rng.random(1 << D.BITS) < 0.5, rng.integers(0, 9, 1 << D.BITS), -1)
    rows = rng.standard_normal((9, 4)).astype(np.float32)
    words = " ".join(f"w{i}" for i in range(100)).split()
    texts = ["", " ".join(words[:5]), " ".join(words), "...", " ".join(words[::-1][:13])]
    _, term, first, end, *_ = D._passages(texts, np.ones(1 << D.BITS))
    blocks = np.arange(len(first))[::-1]
    want = [sum((rows[c] for c in column[term[first[b] : end[b]]] if c >= 0), np.zeros(4)) for b in blocks]
    assert np.allclose(D._project(term, first, end, blocks, column, rows), want, atol=1e-5)
    assert D._project(term[:0], first[:0], end[:0], blocks[:0], column, rows).shape == (0, 4)


def test_only_an_items_own_words_are_compared_with_it(monkeypatch):
    """Windows whose words rule an item out are not compared at all, others by the item's words alone."""
    rng = random.Random(8)
    item = [f"item{i}" for i in range(30)]
    texts = [" ".join(f"other{rng.randrange(999)}" for _ in range(60)) for _ in range(20)]
    texts[3] += " " + " ".join(item)
    texts[7] += " " + " ".join(item[:12])
    idf, column = np.full(1 << D.BITS, 3.0), np.full(1 << D.BITS, -1, np.int32)
    terms = np.unique(D._dims(Words([" ".join(item)]).hash))
    column[terms] = np.arange(len(terms))
    seen = []
    monkeypatch.setattr(D, "lcs", lambda a, b, run=D.lcs: seen.append((set(a), set(b))) or run(a, b))
    items, docs = pd.DataFrame({"item_id": [1], "text": [" ".join(item)]}), pd.DataFrame({"doc_id": range(20), "text": texts})
    found = pd.concat(D._search(items, idf, column, np.eye(len(terms), dtype=np.float32), D.COSINE)([docs]))
    assert found["doc_id"].tolist() == [3] and found["lcs"].tolist() == [1.0]
    assert seen and all(b <= set(D.tokens(" ".join(item))) and len(b) > 12 for _, b in seen)
