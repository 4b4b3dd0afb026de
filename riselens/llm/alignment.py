"""Alignment of two tokenizers by lockstep merging of their token ends.

Both tokenizers read a space and the text, so their tokens cover the same bytes.
A batch of documents is laid end to end, and one NumPy state vector holds a pair
of pointers per lane, into the token ends of A and of B.  Every step links the
two tokens under the pointers, moves past the one that ends first (past both
where they end together, which is a cut) and drops the lanes that have ended.
A document is one lane, or several if it is long: lanes part where a chunk
begins, which is a cut in any case (see ``chunks``), so no lane is much longer
than the others and a step always moves many pointers.

Counts of linked id pairs over the whole corpus: a batch is a block, and its
distinct pairs are numbered.  Blocks write their documents with the numbers of
their links, and their pairs with counts.  Counts are summed by pair, the best
per B id is taken, and both go back to the blocks that hold the pair, so what is
shuffled are distinct pairs of blocks and never links.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import partial
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riselens.llm import pieces
from riselens.llm.chunks import ChunkTable, Chunked, pieces_of
from riselens.llm.common import clean_docs
from riselens.session import checkpoint

LANE = 512
#: Characters of a block: the more, the fewer pairs are repeated between blocks.
BLOCK = 4_000_000
_BAR, _SEMICOLON = 1, 2


def _letters() -> dict[str, int]:
    """The byte of every printable stand-in of byte-level vocabularies."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in kept)
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level vocabulary file: ids of chunks, bytes of ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        letters, added = _letters(), set(self.model.get_added_tokens_decoder())
        vocab = self.model.get_vocab(with_added_tokens=True)
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for name, i in vocab.items():
            self.bytes_of[i] = name.encode() if i in added else bytes(letters[c] for c in name)

    def encode_chunks(self, chunks: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)]


def _spelling(model, chunks: list[bytes]) -> list[list[int]]:
    """Ids of chunks, none for a chunk that its tokens do not spell."""
    return [ids if b"".join(map(model.bytes_of.__getitem__, ids)) == c else [] for ids, c in zip(model.encode_chunks(chunks), chunks)]


@dataclass
class Aligned:
    """Ids end to end for A and B, the bounds of the documents in them, and the links and cuts (positions in the ids) in order."""

    a: np.ndarray
    b: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    link_at: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray
    cut_at: np.ndarray


def merge(a_end: np.ndarray, b_end: np.ndarray, a_from: np.ndarray, b_from: np.ndarray, b_to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (positions of A, of B) and whether a cut follows, of all lanes in lockstep.

    a_end, b_end: ends of all tokens in one buffer; lanes begin at a_from and
    b_from, and end before b_to, where both tokens end.
    """
    total = len(a_end) + len(b_end)
    link_a, link_b, cuts, n = np.empty(total, np.int32), np.empty(total, np.int32), np.empty(total, bool), 0
    a, b, to = a_from, b_from, b_to
    while len(a):
        x, y = a_end[a], b_end[b]
        past_a, past_b = x <= y, y <= x
        k = n + len(a)
        link_a[n:k], link_b[n:k], cuts[n:k] = a, b, past_a & past_b
        a, b, n = a + past_a, b + past_b, k
        live = b < to
        if not live.all():
            a, b, to = a[live], b[live], to[live]
    return link_a[:n], link_b[:n], cuts[:n]


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.first, self.second = ByteLevel(path_a), pieces.Pieces(path_b)
        if not self.second.by_chunk:
            raise ValueError(f"the pieces of {path_b} cross whitespace marks")
        self.table = ChunkTable(*(partial(_spelling, m) for m in (self.first, self.second)))
        self.size = [np.array([len(x) for x in m.bytes_of], np.int64) for m in (self.first, self.second)]
        self.names = max(map(len, self.size))
        named = [b"%d%s" % (i, mark) for mark in (b",", b"|", b";") for i in range(self.names)]
        self.name_size = np.array([len(n) for n in named], np.int64)
        self.name_first = np.cumsum(self.name_size) - self.name_size
        self.name_flat = np.frombuffer(b"".join(named), np.uint8)

    def align(self, texts: list[str]) -> Aligned:
        """Texts whose tokens do not spell the text (with U+2581, which B reads as a space) have no tokens."""
        texts = ["" if pieces.MARK in t else t for t in texts]
        chunked = Chunked(texts)
        rows = self.table.rows(chunked)
        (a, a_chunk), (b, b_chunk) = (ids.gather(rows) for ids in self.table.ids)
        a_end, b_end = np.cumsum(self.size[0][a]), np.cumsum(self.size[1][b])
        if not self._spelt(chunked, a_end, b_end, a_chunk, b_chunk):
            return self.align([t if self._spells(t) else "" for t in texts])
        a_at, b_at = a_chunk[chunked.bounds], b_chunk[chunked.bounds]
        lanes = self._lanes(chunked.bounds, b_chunk)
        bounds = np.append(b_chunk[lanes], len(b))
        link_a, link_b, cuts = merge(a_end, b_end, a_chunk[lanes], bounds[:-1], bounds[1:])
        # a step moves one pointer or both, so no two links have the same sum of positions: it is their order
        place = np.full(len(a) + len(b), -1, np.int32)
        place[link_a + link_b] = np.arange(len(link_a), dtype=np.int32)
        order = place[place >= 0]
        link_a, link_b, cuts = link_a[order], link_b[order], cuts[order]
        cut_a, cut_b = link_a[cuts], link_b[cuts]
        return Aligned(a, b, a_at, b_at, link_a, link_b, np.searchsorted(link_a, a_at), cut_a, cut_b, np.searchsorted(cut_a, a_at))

    @staticmethod
    def _spelt(chunked: Chunked, a_end, b_end, a_chunk, b_chunk) -> bool:
        """Whether every chunk has tokens, of its length (their bytes were compared when the chunk was new)."""
        for end, at in ((a_end, a_chunk), (b_end, b_chunk)):
            if not np.array_equal(np.concatenate(([0], end))[at[1:]], chunked.end):
                return False
        return True

    def _spells(self, text: str) -> bool:
        raw = b" " + text.encode()
        return all(b"".join(map(m.bytes_of.__getitem__, m.encode_chunks([raw])[0])) == raw for m in (self.first, self.second))

    @staticmethod
    def _lanes(bounds: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The chunks where lanes begin: of every text the first, and the first past each further LANE tokens."""
        chunks = np.arange(len(at) - 1)
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        stretch = (at[chunks] - at[bounds[text]]) // LANE
        new = np.ones(len(chunks), bool)
        new[1:] = (text[1:] != text[:-1]) | (stretch[1:] != stretch[:-1])
        return np.flatnonzero(new)

    def groups(self, x: Aligned) -> list[bytes]:
        """Of every document its groups as text: ids of A, a bar, ids of B; groups parted by semicolons."""
        last_a, last_b = np.zeros(len(x.a), bool), np.zeros(len(x.b), bool)
        last_a[x.cut_a] = last_b[x.cut_b] = True
        upto_a, upto_b = np.append(0, x.cut_a + 1), np.append(0, x.cut_b + 1)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        named = np.empty(len(x.a) + len(x.b), np.int64)
        named[np.arange(len(x.a)) + upto_b[group_a]] = x.a + last_a * (_BAR * self.names)
        named[np.arange(len(x.b)) + upto_a[group_b + 1]] = x.b + last_b * (_SEMICOLON * self.names)
        size = self.name_size[named]
        ends = np.concatenate(([0], np.cumsum(size)))
        raw = self.name_flat[np.repeat(self.name_first[named] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        at = ends[x.a_at + x.b_at].tolist()
        return [raw[s : max(s, e - 1)] for s, e in zip(at[:-1], at[1:])]


_loaded: dict[tuple[str, str], Aligner] = {}


def load(path_a: str, path_b: str) -> Aligner:
    key = path_a, path_b
    if key not in _loaded:
        _loaded[key] = Aligner(*key)
    return _loaded[key]


def _paths(path_a: str | None, path_b: str | None) -> tuple[str, str]:
    if path_a is None:
        import public_tokenizers

        path_a = public_tokenizers.path("byte_bpe_50k.json")
    return path_a, path_b or pieces.default_model()


def _lists(values: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(at.astype(np.int32), values.astype(np.int32))


def _local(values: np.ndarray, at: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Positions counted from the beginning of their document."""
    return values - np.repeat(base[:-1], np.diff(at))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, a_ids, b_ids, link_a, link_b, cut_a, cut_b.

    Links are positions of tokens that share bytes, cuts those of the last
    tokens of a group, both from 0 and in order.  Null and empty texts, and
    texts that the tokens do not spell, have empty lists; repeated and null
    doc_ids stay rows of their own; extra columns are ignored.
    """
    paths = _paths(path_a, path_b)

    def run(batches):
        aligner = load(*paths)
        for batch, texts in pieces_of(batches):
            x = aligner.align(texts)
            columns = [_lists(x.a, x.a_at), _lists(x.b, x.b_at)]
            for values, at, base in ((x.link_a, x.link_at, x.a_at), (x.link_b, x.link_at, x.b_at), (x.cut_a, x.cut_at, x.a_at), (x.cut_b, x.cut_at, x.b_at)):
                columns.append(_lists(_local(values, at, base), at))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "a_ids", "b_ids", "link_a", "link_b", "cut_a", "cut_b"])

    return clean_docs(docs).mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, link_a array<int>, link_b array<int>, cut_a array<int>, cut_b array<int>")


_BLOCKS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, block long, links binary, pair array<long>, n array<long>"


def _blocks(paths: tuple[str, str], most: int):
    """Documents of a block, their links as numbers of the block's pairs; the block's first row also holds the pairs and their counts."""

    def run(batches):
        aligner = load(*paths)
        context = TaskContext.get()
        numbers = count((context.partitionId() if context else 0) << 32)
        rows, codes = [], []

        def settle():
            pair, number, n = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
            number = number.astype("<i4")
            cut = np.cumsum([0, *map(len, codes)])
            block = next(numbers)
            frame = pd.DataFrame(rows, columns=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"])
            links = [number[s:e].tobytes() for s, e in zip(cut[:-1], cut[1:])]
            table = pa.table({
                "doc_id": pa.array([r[0] for r in rows], pa.int64()), **{c: pa.array(frame[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")},
                "groups": pa.array([r[5] for r in rows], pa.string()), "block": pa.array([block] * len(rows), pa.int64()), "links": pa.array(links, pa.binary()),
                "pair": pa.array([pair, *[None] * (len(rows) - 1)], pa.list_(pa.int64())), "n": pa.array([n, *[None] * (len(rows) - 1)], pa.list_(pa.int64())),
            })
            rows.clear()
            codes.clear()
            return table.to_batches()

        size = 0
        for batch, texts in pieces_of(batches):
            x = aligner.align(texts)
            code = x.a[x.link_a].astype(np.int64) << 32 | x.b[x.link_b]
            sizes = (np.diff(v).tolist() for v in (x.a_at, x.b_at, x.cut_at, x.link_at))
            rows += zip(batch.column("doc_id").to_pylist(), *sizes, aligner.groups(x))
            codes += [code[s:e] for s, e in zip(x.link_at[:-1], x.link_at[1:])]
            size += sum(map(len, texts))
            if size >= most:
                yield from settle()
                size = 0
        if rows:
            yield from settle()

    return run


def _scores(docs: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """n_best and count_sum of a block's documents."""
    pairs = pairs.sort_values("number")
    best, counts = pairs["best"].to_numpy(np.int64), pairs["count"].to_numpy(np.int64)
    links = np.frombuffer(b"".join(docs["links"]), "<i4")
    at = np.concatenate(([0], np.cumsum([len(x) // 4 for x in docs["links"]], dtype=np.int64)))
    out = docs.drop(columns=["links", "block"])
    for name, values in (("n_best", best), ("count_sum", counts)):
        upto = np.concatenate(([0], np.cumsum(values[links] if len(links) else np.zeros(0, np.int64))))
        out[name] = upto[at[1:]] - upto[at[:-1]]
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out


def link_statistics(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best counts the links whose id pair is linked as often, over the corpus,
    as any with its B id; count_sum adds the counts of all links' pairs.  Rows
    and awkward texts as in ``align``; a document without tokens has zeros and an
    empty groups_sha256.
    """
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    blocks = clean_docs(docs).mapInArrow(_blocks(_paths(path_a, path_b), BLOCK), _BLOCKS)
    blocks = checkpoint(blocks.withColumn("groups_sha256", digest).drop("groups"))
    pairs = blocks.where("pair is not null").select("block", F.posexplode(F.arrays_zip("pair", "n")).alias("number", "p")).select("block", "number", "p.pair", "p.n")
    counts = checkpoint(pairs.groupBy("pair").agg(F.sum("n").alias("count")))
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    most = counts.groupBy(b_id).agg(F.max("count").alias("most"))  # as many rows as B has ids
    scored = counts.withColumn("b", b_id).join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).cast("int").alias("best"))
    back = pairs.drop("n").join(scored, "pair").select(F.col("block").alias("of"), "number", "count", "best")
    own = blocks.drop("pair", "n")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    scores = lambda left, right: _scores(left, right)[[c.split()[0] for c in schema.split(", ")]]
    return own.groupBy("block").cogroup(back.groupBy("of")).applyInPandas(scores, schema)
