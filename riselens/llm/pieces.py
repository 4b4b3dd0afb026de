"""Encoding and decoding with a sentencepiece vocabulary over a table of distinct chunks.

No piece of such a vocabulary holds a whitespace mark after another character,
so no piece crosses the start of a marked word.  A worker segments every
distinct marked word once (``chunks.ChunkTable``) and joins the ids back by
position; decoding gathers the bytes of the pieces in the same way.  A model
whose pieces do cross marks, or which changes its input beyond the marks, is
applied to whole texts instead.  Rows stay where they are: nothing is shuffled.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riselens.llm.chunks import ChunkTable, Chunked, pieces_of
from riselens.llm.common import clean_docs

MARK = "▁"
#: Texts on which a model must do nothing but set marks for its pieces to be used by chunk.
_PROBES = ["a", " a", "a ", "  a  b ", "A\tb\n\nc\r\n", "ﬁ Ａ① é é", "<s> </s> <unk>", "　x y"]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A loaded model: ids of texts, bytes of ids."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceNormalizer, SentencePieceProcessor

        self.sp = sp = SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        kinds = (sp.is_control, sp.is_unknown, sp.is_unused)
        self.odd = np.array([any(kind(i) for kind in kinds) for i in range(len(names))])
        coded = [bytes([int(n[3:5], 16)]) if sp.is_byte(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)]
        self.bytes_of = coded
        self.size = np.array([len(c) for c in coded], np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        self.flat = np.frombuffer(b"".join(coded), np.uint8)
        self.marked = np.array([n.startswith(MARK) for n in names])
        change = SentencePieceNormalizer(model_file=path)
        plain = all(change.normalize(t) == MARK + t.replace(" ", MARK) for t in _PROBES)
        whole = any(re.search(f"[^{MARK}]{MARK}", n) for n in names)
        self.by_chunk = plain and not whole and not any(sp.is_unused(i) for i in range(len(names)))
        self.table = ChunkTable(self.encode_chunks)

    def encode_chunks(self, chunks: list[bytes]) -> list[list[int]]:
        """Ids of chunks; the model itself sets the mark that stands for the first space."""
        ids = self.sp.encode([c[1:].decode() for c in chunks], num_threads=1)
        return [x if len(c) > 1 else [self.sp.piece_to_id(MARK)] for x, c in zip(ids, chunks)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the bounds of the texts in them."""
        if self.by_chunk:
            _, [found] = self.table.encode([t.replace(MARK, " ") for t in texts])
            return found
        ids = self.sp.encode(texts, num_threads=1)
        ends = np.cumsum([0, *map(len, ids)])
        return np.fromiter((i for x in ids for i in x), np.int32, ends[-1]), ends

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The texts' UTF-8 end to end, and their bounds."""
        n = len(ends) - 1
        size, first = self.size[ids], self.first[ids]
        some = ends[:-1][np.diff(ends) > 0]
        drop = some[self.marked[ids[some]]]  # the mark that encoding set
        size[drop] -= 1
        first[drop] += 1
        upto = np.concatenate(([0], np.cumsum(size)))
        raw = self.flat[np.repeat(first - upto[:-1], size) + np.arange(upto[-1])].tobytes()
        at = upto[ends]
        if self.by_chunk and not self.odd[ids].any() and _valid(raw, at):
            return raw, at
        texts = [self.sp.decode(ids[a:b].tolist()).encode() for a, b in zip(ends[:-1], ends[1:])]
        return b"".join(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))[: n + 1]


def _valid(raw: bytes, at: np.ndarray) -> bool:
    """Whether every text between the bounds is whole UTF-8."""
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    inner = at[at < len(raw)]
    return not (np.frombuffer(raw, np.uint8)[inner] & 0xC0 == 0x80).any()


_loaded: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids), one row per row of ``docs``: the whole text's ids, without begin and end ids.

    Null and empty texts have no ids; blank texts have those of their marks.
    Rows with null or repeated doc_ids are encoded one by one; a text of any
    length is one row; extra columns are ignored; an empty table stays empty.
    """
    path = model or default_model()

    def run(batches):
        pieces = load(path)
        for batch, texts in pieces_of(batches):
            ids, ends = pieces.encode(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(ends.astype(np.int32), ids)], ["doc_id", "ids"])

    return clean_docs(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of rows of (doc_id, ids); null and empty ids give empty texts.

    Ids of bytes that form no character become U+FFFD, as in the library;
    repeated and null doc_ids stay rows of their own; other columns are ignored.
    """
    path = model or default_model()

    def run(batches):
        pieces = load(path)
        for batch in batches:
            for some in _slices(batch):
                lists = some.column("ids")
                ends = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)))
                raw, at = pieces.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), ends)
                text = pa.StringArray.from_buffers(len(some), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), text], ["doc_id", "text"])

    ids = F.coalesce(F.col("ids"), F.array().cast("array<int>")).alias("ids")
    return encoded.select("doc_id", ids).mapInArrow(run, "doc_id long, text string")


def _slices(batch: pa.RecordBatch, limit: int = 250_000):
    """Slices of a batch with about ``limit`` ids each; one row alone may exceed it."""
    sizes = batch.column("ids").value_lengths().fill_null(0).to_pylist()
    size, first = 0, 0
    for i, n in enumerate(sizes):
        if size and size + n > limit:
            yield batch.slice(first, i - first)
            size, first = 0, i
        size += n
    if first < len(sizes):
        yield batch.slice(first)


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids, text): every text's ids, and what they decode to; rows as in ``encode``."""
    path = model or default_model()

    def run(batches):
        pieces = load(path)
        for batch, texts in pieces_of(batches):
            ids, ends = pieces.encode(texts)
            raw, at = pieces.decode(ids.astype(np.int64), ends)
            text = pa.StringArray.from_buffers(len(batch), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(ends.astype(np.int32), ids), text], ["doc_id", "ids", "text"])

    return clean_docs(docs).mapInArrow(run, "doc_id long, ids array<int>, text string")
