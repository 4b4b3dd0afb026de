"""Order-preserving packing of token streams into windows by dynamic programming.

Every Spark partition packs its own documents in their order: a stream of ids
is cut into sequences of at most ``window`` ids.  Cuts may lie at document ends
(free), at sentence ends (``sentence`` penalty) and, where neither comes for a
while, anywhere (``hard`` penalty).  With f(i) the least cost of all ids before
cut i,

    f(i) = window - pos(i) + penalty(i) + min over j of f(j) + pos(j),
           pos(i) - window <= pos(j) < pos(i),

so a monotone queue over f(j) + pos(j) finds each minimum in constant time.
The stream is worked off in stretches of bounded length; the sequence left open
at the end of one goes on in the next.  The last sequence of a partition is cut
into powers of two, which need no padding.  No row is shuffled, and nothing but
one stretch is held in memory (a longer text alone may exceed it).
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from riselens.llm.chunks import Ragged, Slots
from riselens.llm.common import clean_docs
from riselens.llm.textbuf import Words, batches

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
WINDOW = 4096
STRETCH = 1 << 19
END_ID = 2
CACHE_WORDS = 500_000
#: The pre-token pattern of the vocabulary file, and the characters
#: (printable ASCII, precomposed Latin letters) on which its NFC step does nothing.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
PLAIN = "[\x21-\x7eÀ-ÖØ-öø-įı-ſ]+"


def _byte_letters() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return [chr(b) if b in set(kept) else chr(256 + rest.index(b)) for b in range(256)]


class WordTokens:
    """Ids of whole texts; each distinct white-space word is encoded once per worker.

    Words never share a token across white space in this vocabulary, so a text's
    ids are its words' ids in a row.  Plain Latin words go through the
    tokenizer's own BPE model directly; all others through its full pipeline.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        self.letters = _byte_letters()
        self.plain, self.pre = regex.compile(PLAIN), regex.compile(PRETOKEN)
        vocab = self.full.get_vocab(with_added_tokens=True)
        self.stops = np.zeros(max(vocab.values()) + 1, bool)
        self.stops[[i for t, i in vocab.items() if t.removesuffix("</w>")[-1:] in ".!?" and t.removesuffix("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.slots, self.ids = Slots(), Ragged()
        self.pieces: dict[str, list[int]] = {}

    def ids_of(self, word: str) -> list[int]:
        if not self.plain.fullmatch(word) or "<|" in word:
            return self.full.encode(word, add_special_tokens=False).ids
        out = []
        for p in self.pre.findall(word.lower()):
            ids = self.pieces.get(p)
            if ids is None:
                name = p if p.isascii() else "".join(map(self.letters.__getitem__, p.encode()))
                ids = self.pieces[p] = [t.id for t in self.model.tokenize(name)]
            out += ids
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """For each text its ids, as int32."""
        words = Words(texts)
        if self.ids.n > CACHE_WORDS:
            self.forget()
        rows = self.slots.find(words.hash, words.hash)
        new = np.flatnonzero(rows < 0)
        if len(new):
            fresh, first, own = np.unique(words.hash[new], return_index=True, return_inverse=True)
            base, raw, at = self.ids.n, words.raw, new[first]
            self.ids.extend([self.ids_of(raw[s:e].decode("utf-8", "replace")) for s, e in zip(words.start[at].tolist(), words.end[at].tolist())])
            rows[new] = base + own
            self.slots.add(fresh, fresh, base + np.arange(len(fresh)))
        ids, ends = self.ids.gather(rows)
        cut = ends[words.bounds]
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:])]


_loaded: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]


def best_cuts(pos: np.ndarray, penalty: np.ndarray, window: int) -> list[int]:
    """Positions of the cheapest cuts: ``pos`` rises, starts at 0, ends at the end."""
    p, pen = pos.tolist(), penalty.tolist()
    f, back = [0] * len(p), [0] * len(p)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # f + pos, pos, index
    for i in range(1, len(p)):
        here = p[i]
        while queue[0][1] < here - window:
            queue.popleft()
        g, _, back[i] = queue[0]
        f[i] = cost = g + window - here + pen[i]
        key = cost + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, here, i))
    cuts, i = [], len(p) - 1
    while i:
        cuts.append(p[i])
        i = back[i]
    return cuts[::-1]


def _candidates(fragments, stops: np.ndarray, window: int, sentence: int, hard: int):
    ids = np.concatenate([x[2] for x in fragments])
    doc_ends = np.cumsum([len(x[2]) for x in fragments])
    cost = np.full(len(ids) + 1, -1, np.int64)
    step = max(1, window // 16)
    cost[::step] = hard
    cost[1:][stops[ids]] = sentence
    cost[doc_ends] = 0
    cost[0] = 0
    pos = np.flatnonzero(cost >= 0)
    return ids, doc_ends, pos, cost[pos]


def _halves(n: int) -> list[int]:
    """n as a sum of falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def _pack(path: str, window: int, sentence: int, hard: int):
    def run(frames):
        tokens = word_tokens(path)
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 36
        fragments: list[tuple] = []  # doc_id, ids before it, ids, ids of the document
        held = 0

        def settle(last: bool):
            nonlocal fragments, held, number
            ids, doc_ends, pos, cost = _candidates(fragments, tokens.stops, window, sentence, hard)
            cuts = best_cuts(pos, cost, window)
            edge = cuts[-2] if len(cuts) > 1 else 0
            if last:
                tail = np.cumsum([edge, *_halves(cuts[-1] - edge)]).tolist()[1:]
                cuts = cuts[:-1] + tail
            else:
                cuts = cuts[:-1]
            rows, left, begin, k, used = [], [], 0, 0, 0
            for end in cuts:
                at = begin
                while at < end:
                    doc_id, start, own, total = fragments[k]
                    take = min(end, int(doc_ends[k])) - at
                    rows.append((doc_id, start + used, take, zlib.crc32(ids[at : at + take].astype("<u4").tobytes()), total, number, at - begin))
                    at, used = at + take, used + take
                    if at == doc_ends[k]:
                        k, used = k + 1, 0
                begin, number = end, number + 1
            if not last:
                left = [(d, s + used * (j == 0), own[used if j == 0 else 0 :], t) for j, (d, s, own, t) in enumerate(fragments[k:])]
            fragments, held = left, sum(len(x[2]) for x in left)
            return pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]).astype({"doc_id": "Int64"})

        for pdf in batches(frames):
            for doc_id, ids in zip(pdf["doc_id"].astype("Int64"), tokens.encode(pdf["text"].tolist())):
                ids = np.append(ids, np.int32(END_ID))
                fragments.append((doc_id, 0, ids, len(ids)))
                held += len(ids)
            if held > STRETCH:
                yield settle(False)
        if held:
            yield settle(True)

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, sentence: int = 24, hard: int = 256) -> DataFrame:
    """One row per piece of a document in a sequence (see SCHEMA).

    tokenizer: the vocabulary file, by default the public 49k word BPE.  Null
    and empty texts are the single closing id; a document longer than the window
    spans several sequences; rows with equal or null doc_ids are packed one by
    one; extra columns are ignored; an empty table gives no piece.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return clean_docs(docs).mapInPandas(_pack(tokenizer, window, sentence, hard), SCHEMA)
