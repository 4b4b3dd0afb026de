"""Benchmark decontamination by latent semantic retrieval.

Documents are read as overlapping passages of WINDOW words, a new one every STEP
words.  Inverse document frequencies come from all passages of the corpus, over
hashed words.  Benchmark items (pieces of at most WINDOW words) and all words of the
corpus, in rows of WINDOW, give the TF-IDF matrix whose randomised SVD
is computed in Spark: each pass of subspace iteration sums A'(AQ) over tasks,
one block of terms per group.  Item rows weigh ITEM_WEIGHT and all corpus rows
together as much as CORPUS_ROWS rows of weight 1, so that the space keeps what
tells items apart however large the corpus is.  Its right singular vectors are the latent space.

Candidate search covers every passage: the cosine of passage x and item b is
(Vx)(Vb) / (|x| |Vb|).  Terms outside the benchmark's vocabulary only lengthen
x, so |x restricted to that vocabulary| / |x| bounds the cosine and passages
below COSINE by this bound need no projection (both lengths
are sums over words).  Terms in more than STOP_SHARE of all blocks are stop words:
they count for lengths only.  Candidates are then decided on
their words: the longest common subsequence with the item must reach LCS of its
words, or LCS_ANSWER of them with the item's closing sentence (its answer)
nearly whole, so light paraphrases count as leaks and topical likeness does not.

A basis of RANK dimensions tells about ITEMS items apart, so items are searched in
blocks of ITEMS with a basis each.  Passages that hold any SEED neighbouring words
of an item (all words of a shorter one) are candidates whatever their cosine, so
an item that stands in a document word for word is never lost.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riselens.llm.common import clean_docs
from riselens.llm.textbuf import Words, batches, distinct, mix

WINDOW, STEP = 48, 12
BITS = 18
RANK = 256
ITEMS = 200
SEED = 4
ITEM_WEIGHT = 16.0
CORPUS_ROWS = 2000
ROWS = 64
BLOCK = 1024
COSINE = 0.3
STOP_SHARE = 1 / 64
LCS, LCS_ANSWER, ANSWER = 0.7, 0.55, 0.8
_MUL = np.uint64(0xD6E8FEB86659FD93)
PAIRS = "doc_id long, item_id long, cosine double, lcs double, answer double, word long"


def _dims(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _frequencies(frames):
    """Passages a term is in (a term's blocks of STEP words stand for its passages), and the number of blocks under term -1."""
    total, blocks = np.zeros(1 << BITS, np.int64), 0
    for pdf in batches(frames):
        words = Words(pdf["text"].tolist(), lower=True, alnum=True)
        n = np.diff(words.bounds)
        block = (np.arange(len(words.hash)) - np.repeat(words.bounds[:-1], n)) // STEP
        per = -(-n // STEP)
        where = block + np.repeat(np.cumsum(per) - per, n)
        seen = distinct(where << BITS | _dims(words.hash))
        total += np.bincount(seen & ((1 << BITS) - 1), minlength=1 << BITS)
        blocks += int(per.sum())
    at = np.flatnonzero(total)
    yield pd.DataFrame({"term": np.append(at, -1), "c": np.append(total[at], blocks)})


def idf_weights(docs: DataFrame) -> tuple[np.ndarray, int]:
    """ln((1 + blocks) / (1 + blocks with the term)) for each of the 2^BITS hashed terms, and the number of blocks."""
    rows = docs.mapInPandas(_frequencies, "term int, c long").groupBy("term").agg(F.sum("c").alias("c")).toArrow()
    term, c = rows["term"].to_numpy(), rows["c"].to_numpy()
    count = np.zeros(1 << BITS)
    known = term >= 0
    count[term[known]] = c[known]
    blocks = int(c[~known].sum())
    return np.log((1 + blocks) / (1 + count)) + 1e-3, blocks


def _passages(texts: list[str], idf: np.ndarray):
    """Blocks of STEP words and the passages of up to WINDOW words that begin at each.

    Returns words, the terms, each block's first and end word, each passage's
    first block, end block and text.  A block that no full passage needs as its
    beginning has none, except the first of a text.
    """
    words = Words(texts, lower=True, alnum=True)
    n, per = np.diff(words.bounds), WINDOW // STEP
    count = -(-n // STEP)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    first = words.bounds[:-1][text] + k * STEP
    end = np.minimum(first + STEP, words.bounds[1:][text])
    begin = np.flatnonzero((k == 0) | (k * STEP + WINDOW - STEP < n[text]))
    last = np.minimum(begin + per, np.cumsum(count)[text[begin]])
    return words, _dims(words.hash), first, end, begin, last, text


def _project(term, first, end, blocks, column, rows):
    """For each of the named blocks the sum of its words' rows."""
    out = np.zeros((len(blocks), rows.shape[1]), np.float32)
    place = first[blocks][:, None] + np.arange(STEP)
    row = column[term[np.minimum(place, max(len(term) - 1, 0))]] if len(term) else np.full(place.shape, -1)
    known = (place < end[blocks][:, None]) & (row >= 0)
    n, row = known.sum(1), row[known]
    # blocks of many known words first: those with a k-th one are the first ``more``
    order = np.argsort(-n, kind="stable")
    at, sums = (np.cumsum(n) - n)[order], np.zeros_like(out)
    for k in range(n.max(initial=0)):
        more = int(np.searchsorted(-n[order], -k))
        sums[:more] += np.take(rows, row[at[:more] + k], axis=0)
    out[order] = sums
    return out


def _add_products(total: np.ndarray, row: np.ndarray, col: np.ndarray, scale: np.ndarray, q: np.ndarray) -> None:
    """Adds C' (scale * C q) to ``total``, C being the counts of the entries (row, col); rows ascend.

    ROWS rows at a time, as a small dense matrix of the columns that they hold.
    """
    cuts = np.searchsorted(row, np.arange(0, len(scale) + ROWS, ROWS))
    place = np.zeros(len(q), np.int64)
    for lo, a, b in zip(range(0, len(scale), ROWS), cuts[:-1], cuts[1:]):
        if a == b:
            continue
        size, c = min(ROWS, len(scale) - lo), col[a:b]
        here = np.zeros(len(q), bool)
        here[c] = True
        held = np.flatnonzero(here)
        place[held] = np.arange(len(held))
        counts = np.bincount((row[a:b] - lo) * len(held) + place[c], minlength=size * len(held))
        counts = counts.astype(np.float32).reshape(size, len(held))
        total[held] += counts.T @ (counts @ q[held] * scale[lo : lo + size])


def randomised_svd(passages: DataFrame, idf: np.ndarray, column: np.ndarray, width: int, rank: int) -> np.ndarray:
    """Right singular vectors (width x rank) of the passages' TF-IDF matrix, by two rounds of subspace iteration."""
    rng = np.random.Generator(np.random.PCG64(7))
    basis = rng.standard_normal((width, rank)).astype(np.float32)
    squares, own = idf**2, np.zeros((width, 1), np.float32)
    own[column[column >= 0], 0] = idf[column >= 0]
    for _ in range(2):
        bound = passages.sparkSession.sparkContext.broadcast(basis)

        def part(frames, bound=bound):
            q = bound.value * own
            total = np.zeros((width, rank), np.float32)
            for pdf in batches(frames):
                words = Words(pdf["text"].tolist(), lower=True, alnum=True)
                term, n = _dims(words.hash), np.diff(words.bounds)
                row = (np.arange(len(term)) - np.repeat(words.bounds[:-1], n)) // WINDOW + np.repeat(np.cumsum(-(-n // WINDOW)) - -(-n // WINDOW), n)
                if not len(row):
                    continue
                weight = np.zeros(row[-1] + 1)
                weight[row] = pdf["weight"].to_numpy()[words.doc]
                # an entry is weight / length of its row times its term's idf: both factors are taken out of the products
                scale = (weight**2 / np.bincount(row, squares[term])).astype(np.float32)[:, None]
                col = column[term]
                use = np.flatnonzero(col >= 0)
                row, col = row[use], col[use]
                _add_products(total, row, col, scale, q)
            total *= own
            for b in range(0, width, BLOCK):
                yield pd.DataFrame({"block": [b], "sums": [total[b : b + BLOCK].tobytes()]})

        def add(key, pdf):
            total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in pdf["sums"])
            return pd.DataFrame({"block": [key[0]], "sums": [total.astype(np.float32).tobytes()]})

        sums = passages.mapInPandas(part, "block int, sums binary").groupBy("block").applyInPandas(add, "block int, sums binary").toPandas()
        w = np.concatenate([np.frombuffer(x, np.float32) for x in sums.sort_values("block")["sums"]]).reshape(width, rank)
        basis = np.linalg.qr(w.astype(np.float64))[0].astype(np.float32)
    return basis


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def tokens(text: str) -> list[int]:
    """The hashes of a text's words."""
    return Words([text], lower=True, alnum=True).hash.tolist()


def closing(text: str) -> list[int]:
    """Words of the last sentence of at least three words, or of the whole item."""
    parts = [p for p in map(tokens, re.split(r"[.!?\n]", text)) if len(p) >= 3]
    return parts[-1] if parts else tokens(text)


def _runs(h: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size`` words from each place in ``first``."""
    out = np.full(len(first), size, np.uint64)
    for k in range(size):
        out = mix(out * _MUL + h[first + k])
    return out


def _seeds(item_words: list[list[int]]):
    """For each length of run its sorted hashes, with the item and place in the item of each."""
    out = {}
    for size in range(1, SEED + 1):
        parts = []
        for j, words in enumerate(item_words):
            if size == min(SEED, len(words)):
                place = np.arange(len(words) - size + 1)
                parts.append((_runs(np.array(words, np.uint64), place, size), np.full(len(place), j), place))
        if parts:
            h, item, place = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            out[size] = h[order], item[order], place[order]
    return out


def _search(items: pd.DataFrame, idf, column, basis, cosine: float):
    ids, texts = items["item_id"].tolist(), items["text"].tolist()
    words, term, first, end, _, _, text = _passages(texts, idf)
    # an item longer than a passage is sought by its pieces of WINDOW words
    weight = np.zeros((len(basis), 1), np.float32)
    weight[column[column >= 0], 0] = idf[column >= 0]
    weighted = basis * weight
    block = _project(term, first, end, np.arange(len(first)), column, weighted)
    order = np.arange(len(text)) - np.searchsorted(text, text)
    piece, at = np.unique(text * (1 << 32) + order // (WINDOW // STEP), return_inverse=True)
    owner = piece >> 32
    latent = np.zeros((len(piece), basis.shape[1]), np.float32)
    np.add.at(latent, at, block)
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    # (Vx)(Vb) is a sum over the words of x: each word's products with all pieces are taken once
    products = weighted @ latent.T if len(piece) <= 2 * basis.shape[1] else None
    item_words, answers = [tokens(t) for t in texts], [closing(t) for t in texts]
    item_hashes = [np.unique(np.array(x, np.uint64)) for x in item_words]
    seeds = _seeds(item_words)
    seed_bits = {size: np.bincount((h >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS) > 0 for size, (h, _, _) in seeds.items()}

    def seeded(words, begin, text):
        """Sorted numbers passage * len(piece) + piece of the passages that hold a seed."""
        found = [np.zeros(0, np.int64)]
        blocks = np.cumsum(np.concatenate(([0], -(-np.diff(words.bounds) // STEP))))
        for size, (h, item, place) in seeds.items():
            at = np.arange(max(len(words.hash) - size + 1, 0))
            run = _runs(words.hash, at, size)
            at = np.flatnonzero(seed_bits[size][(run >> np.uint64(64 - BITS)).astype(np.int64)] & (words.doc[at] == words.doc[at + size - 1]))
            lo, hi = np.searchsorted(h, run[at], "left"), np.searchsorted(h, run[at], "right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            at, k = np.repeat(at, n), np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            d = words.doc[at]
            block = blocks[d] + (at - words.bounds[d]) // STEP
            # the passage that begins with the word's block, or the text's last one
            passage = np.searchsorted(begin, block, "right") - 1
            found.append(passage * len(piece) + np.searchsorted(piece, item[k] * (1 << 32) + place[k] // WINDOW))
        return distinct(np.concatenate(found))

    def run(frames):
        squares = idf**2
        inside = np.where(column >= 0, squares, 0.0)
        for pdf in batches(frames):
            ids_here = pdf["doc_id"].tolist()
            words, term, first, end, begin, last, text = _passages(pdf["text"].tolist(), idf)
            known = np.concatenate(([0], np.cumsum(inside[term])))
            every = np.concatenate(([0], np.cumsum(squares[term])))
            head, tail = (first[begin], end[last - 1]) if len(begin) else (begin, begin)
            whole = np.maximum(every[tail] - every[head], 1e-9)
            sure = seeded(words, begin, text)
            near = known[tail] - known[head] >= cosine**2 * whole
            near[sure // len(piece)] = True
            near = np.flatnonzero(near)
            out = []
            for lo in range(0, len(near), 8192):
                some = near[lo : lo + 8192]
                need = distinct(np.concatenate([begin[some] + p for p in range(WINDOW // STEP)]))
                need = need[need < len(first)]
                rows = weighted if products is None else products
                block = np.concatenate((_project(term, first, end, need, column, rows), np.zeros((1, rows.shape[1]), np.float32)))
                x = np.zeros((len(some), rows.shape[1]), np.float32)
                for p in range(WINDOW // STEP):
                    b = begin[some] + p
                    x += np.take(block, np.where(b < last[some], np.searchsorted(need, b), len(need)), axis=0)
                score = (x @ latent.T if products is None else x) / np.sqrt(whole[some]).astype(np.float32)[:, None]
                wanted = score >= cosine
                here = sure[slice(*np.searchsorted(sure // len(piece), [some[0], some[-1] + 1]))]
                wanted[np.searchsorted(some, here // len(piece)), here % len(piece)] = True
                for i, j in zip(*np.divmod(np.flatnonzero(wanted), len(piece))):
                    out.append((int(text[begin[some[i]]]), int(owner[j]), float(score[i, j]), int(head[some[i]])))
            best: dict = {}
            for d, j, c, at in out:
                best.setdefault((d, j), []).append((c, at))
            found = []
            for (d, j), hits in best.items():
                n = len(item_words[j])
                top = (0.0, 0.0, 0.0, 0)
                for c, at in hits:
                    a, b = max(at - n, int(words.bounds[d])), min(at + WINDOW + n, int(words.bounds[d + 1]))
                    # words that the item does not have are in no common subsequence
                    here = words.hash[a:b]
                    own = item_hashes[j]
                    here = here[own[np.minimum(np.searchsorted(own, here), len(own) - 1)] == here].tolist()
                    most = len(here) / max(n, 1)
                    if most < LCS_ANSWER or most <= top[1]:
                        continue
                    got = lcs(item_words[j], here) / max(n, 1)
                    if got > top[1]:
                        top = (c, got, lcs(answers[j], here) / max(len(answers[j]), 1), at - int(words.bounds[d]))
                if top[1] >= LCS or top[1] >= LCS_ANSWER and top[2] >= ANSWER:
                    found.append((ids_here[d], ids[j], *top))
            yield pd.DataFrame(found, columns=["doc_id", "item_id", "cosine", "lcs", "answer", "word"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, cosine: float = COSINE) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer, word): documents holding a benchmark item, whole or lightly reworded.

    word: the word offset of the best passage.  Items without words and null ids
    on either side match nothing; items with equal text each get their rows;
    repeated documents give equal rows once; an empty table on either side gives
    an empty result; extra columns are ignored.  The benchmark, the latent basis
    (2^BITS x rank at most) and the term weights are the only data sent to all
    tasks; the benchmark is taken to be small beside the corpus.
    """
    docs = clean_docs(docs).where("doc_id is not null")
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text").toPandas()
    items = items[[bool(tokens(t)) for t in items["text"]]].sort_values("item_id")
    if items.empty:
        return docs.sparkSession.createDataFrame([], PAIRS)
    idf, blocks = idf_weights(docs)
    rows = max(blocks * STEP / WINDOW, 1.0)
    corpus = docs.select("text", F.lit(min(1.0, float(np.sqrt(CORPUS_ROWS / rows)))).alias("weight"))
    found = [docs.mapInPandas(_block_search(corpus, items[lo : lo + ITEMS], idf, rank, cosine), PAIRS) for lo in range(0, len(items), ITEMS)]
    return reduce(DataFrame.union, found).dropDuplicates(["doc_id", "item_id"])


def _block_search(corpus: DataFrame, items: pd.DataFrame, idf: np.ndarray, rank: int, cosine: float):
    """The search for one block of items, in the latent space of theirs."""
    column = np.full(1 << BITS, -1, np.int32)
    used = []
    for text in items["text"]:
        t = np.unique(_dims(Words([text], lower=True, alnum=True).hash))
        rare = t[idf[t] >= -np.log(STOP_SHARE)]
        # an item made mostly of stop words keeps them all, else nothing could find it
        used.append(rare if (idf[rare] ** 2).sum() >= 0.5 * (idf[t] ** 2).sum() else t)
    vocabulary = np.unique(np.concatenate(used))
    column[vocabulary] = np.arange(len(vocabulary))
    own = corpus.sparkSession.createDataFrame([(t, ITEM_WEIGHT) for t in items["text"]], "text string, weight double")
    basis = randomised_svd(corpus.unionByName(own), idf, column, len(vocabulary), min(rank, len(vocabulary)))
    return _search(items, idf, column, basis, cosine)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents in which an item was found; rows with null ids stay."""
    return docs.join(find_leaks(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti")
