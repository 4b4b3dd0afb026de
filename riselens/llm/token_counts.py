"""Token counts by dynamic programming over a trie of distinct pre-tokens.

Pre-tokens are white-space words, each with the vocabulary's word mark before
it.  A worker sorts the distinct ones of a batch, which lays out their trie: a
node is a maximal run of words with a common prefix.  Going down level by level,
the best unigram score of a prefix is computed once per node from its ancestors
(one look-up per piece length, all nodes of a level at a time) and shared by
every word below.  A word's terminal node holds its token count; a document's
count is the sum over its words.  Known words are kept between batches, up to a
bound.

Scores: the vocabulary is ranked, not scored, so a piece of rank r has the Zipf
log-probability -log(r + 1); a byte outside any piece costs BYTE_SCORE.  Among
equal scores the segmentation of fewer tokens counts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from riselens.llm.common import clean_docs
from riselens.llm.textbuf import _BYTE, _P_INV, Words, batches

BYTE_SCORE = -20.0
MARK = "▁".encode()
WIDE = 48
CACHE_WORDS = 2_000_000


class Vocabulary:
    """scores: bytes of a piece -> score; by_length: sorted hashes and their scores."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        groups: dict[int, list[bytes]] = {}
        for p in scores:
            groups.setdefault(len(p), []).append(p)
        self.by_length = {}
        for n, pieces in groups.items():
            if n <= WIDE:
                matrix = np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, n)
                h = (_BYTE[matrix] * _powers(n)[None, :]).sum(axis=1, dtype=np.uint64)
                order = np.argsort(h)
                self.by_length[n] = h[order], np.array([scores[p] for p in pieces])[order]


def _powers(n: int) -> np.ndarray:
    out = np.full(n, np.uint64(0x9E3779B97F4A7C15), np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def load_vocabulary(path: str) -> Vocabulary:
    """Pieces of a sentencepiece file without control, unknown and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = [sp.is_control, sp.is_unknown, sp.is_byte, sp.is_unused]
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not any(f(i) for f in skip)]
    return Vocabulary({p.encode(): -math.log(r + 2) for r, p in enumerate(pieces)})


def count_word(word: bytes, vocab: Vocabulary) -> int:
    """Forward scores along one word; for words too long to be worth a trie."""
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for end in range(1, len(word) + 1):
        top, count = best[end - 1][0] + BYTE_SCORE, best[end - 1][1] + 1
        for n in range(1, min(end, vocab.longest) + 1):
            s = vocab.scores.get(word[end - n : end])
            if s is not None:
                t, c = best[end - n][0] + s, best[end - n][1] + 1
                if t > top or t == top and c < count:
                    top, count = t, c
        best[end] = top, count
    return best[-1][1]


def trie_counts(words: list[bytes], vocab: Vocabulary) -> np.ndarray:
    """Token counts of distinct words of at most WIDE bytes, in their order."""
    if not words:
        return np.zeros(0, np.int64)
    order = sorted(range(len(words)), key=words.__getitem__)
    words = [words[i] for i in order]
    size = np.array([len(w) for w in words])
    wide = int(size.max())
    letters = np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in words), np.uint8).reshape(-1, wide)
    same = np.cumprod(letters[1:] == letters[:-1], axis=1).sum(axis=1)
    common = np.concatenate(([0], np.minimum(same, np.minimum(size[1:], size[:-1]))))
    total = np.zeros((len(words), wide + 1), np.uint64)
    np.cumsum(_BYTE[letters] * _powers(wide)[None, :], axis=1, dtype=np.uint64, out=total[:, 1:])
    inverse = np.cumprod(np.concatenate(([np.uint64(1)], np.full(wide, _P_INV, np.uint64))), dtype=np.uint64)
    score = np.zeros((len(words), wide + 1))
    count = np.zeros((len(words), wide + 1), np.int32)
    for depth in range(1, wide + 1):
        below = np.flatnonzero(size >= depth)
        new = (common[below] < depth) | (np.diff(below, prepend=-2) > 1)
        node = below[new]  # the first word under each node of this level
        top, num = score[node, depth - 1] + BYTE_SCORE, count[node, depth - 1] + 1
        for n in range(1, min(depth, vocab.longest) + 1):
            if n not in vocab.by_length:
                continue
            keys, values = vocab.by_length[n]
            h = (total[node, depth] - total[node, depth - n]) * inverse[depth - n]
            at = np.searchsorted(keys, h)
            at[at == len(keys)] = 0
            hit = np.flatnonzero(keys[at] == h)
            t, c = score[node[hit], depth - n] + values[at[hit]], count[node[hit], depth - n] + 1
            better = (t > top[hit]) | (t == top[hit]) & (c < num[hit])
            top[hit[better]], num[hit[better]] = t[better], c[better]
        of = np.cumsum(new) - 1
        score[below, depth], count[below, depth] = top[of], num[of]
    out = np.empty(len(words), np.int64)
    out[order] = count[np.arange(len(words)), size]
    return out


_vocabularies: dict[str, Vocabulary] = {}


def _count(path: str):
    def run(frames):
        vocab = _vocabularies.get(path) or _vocabularies.setdefault(path, load_vocabulary(path))
        known, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for pdf in batches(frames):
            words = Words(pdf["text"].tolist())
            distinct, first, codes = np.unique(words.hash, return_index=True, return_inverse=True)
            at = np.searchsorted(known, distinct)
            at[at == len(known)] = 0
            old = known[at] == distinct if len(known) else np.zeros(len(distinct), bool)
            values = np.zeros(len(distinct), np.int64)
            values[old] = counts[at[old]]
            new = np.flatnonzero(~old)
            raw = words.raw
            fresh = [MARK + raw[s:e] for s, e in zip(words.start[first[new]].tolist(), words.end[first[new]].tolist())]
            short = np.array([len(w) <= WIDE for w in fresh], bool)
            values[new[short]] = trie_counts([w for w in fresh if len(w) <= WIDE], vocab)
            values[new[~short]] = [count_word(w, vocab) for w in fresh if len(w) > WIDE]
            if len(known) > CACHE_WORDS:
                known, counts = distinct, values
            else:
                known, counts = np.concatenate((known, distinct[new])), np.concatenate((counts, values[new]))
                order = np.argsort(known, kind="stable")
                known, counts = known[order], counts[order]
            sums = np.concatenate(([0], np.cumsum(values[codes])))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_pretokens": np.diff(words.bounds), "n_tokens": sums[words.bounds[1:]] - sums[words.bounds[:-1]]})

    return run


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens), one row per row of ``docs``.

    Null, empty and blank texts count 0; repeated rows and null ids are counted
    row by row; extra columns are ignored; an empty table stays empty.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    return clean_docs(docs).mapInPandas(_count(vocabulary), "doc_id long, n_pretokens long, n_tokens long")
