"""A table of distinct chunks: each is tokenised once per worker, and texts gather its ids.

A batch of texts lies in one byte buffer, a space before each.  A chunk begins at
a space that follows a character other than white space, and so holds its marks
and one word.  Chunks are told apart by two 64-bit hashes over their 8-byte
words; together with the length that is the chunk itself up to 8 bytes, and a
128-bit identity beyond.  All look-ups are array operations; Python sees a chunk
only when it is new.  The table is bounded: past its limits it starts afresh.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

LIMIT = 1_000_000
MOST_CHUNKS = 1 << 20
MOST_IDS = 8 << 20
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_KEEP = np.array([(1 << 8 * n) - 1 if n < 8 else 2**64 - 1 for n in range(9)], np.uint64)
_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


def pieces_of(batches: Iterator[pa.RecordBatch], limit: int = LIMIT) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Re-cuts Arrow batches to about ``limit`` characters, with their texts; one text alone may exceed it."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        size, first = 0, 0
        for i, text in enumerate(texts):
            if size and size + len(text) > limit:
                yield batch.slice(first, i - first), texts[first:i]
                size, first = 0, i
            size += len(text)
        if first < len(texts):
            yield batch.slice(first), texts[first:]


class Chunked:
    """raw, buf: the buffer; start, end: of each chunk; text_at: where each text begins, and the end; bounds: the first chunk of each text, and the end."""

    def __init__(self, texts: list[str]):
        coded = [b" " + t.encode() if t else b"" for t in texts]
        self.text_at = np.concatenate(([0], np.cumsum([len(c) for c in coded], dtype=np.int64)))
        self.raw = b"".join(coded)
        self.buf = buf = np.frombuffer(self.raw, np.uint8)
        at = np.flatnonzero((buf[1:] == 0x20) & ~_WHITE[buf[:-1]]) + 1
        at = at[~_after_wide_space(buf, at)]
        first = self.text_at[:-1][np.diff(self.text_at) > 0]
        mark = np.zeros(len(buf) + 1, bool)
        mark[at] = mark[first] = True
        self.start = np.flatnonzero(mark)
        self.end = np.append(self.start[1:], len(buf)) if len(self.start) else self.start
        self.bounds = np.searchsorted(self.start, self.text_at)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        return span_hashes(self.raw, self.start, self.end - self.start)


def span_hashes(raw: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the given bytes of ``raw``, eight bytes of all spans at a time."""
    words = np.ndarray(len(raw) + 1, "<u8", raw + bytes(8), strides=(1,))
    one, two = (size.astype(np.uint64) * odd for odd in _ODD)
    at, live, left = start, None, size
    while len(at):
        w = words[at] & _KEEP[np.minimum(left, 8)]
        if live is None:
            one, two = _stir(one ^ w, _ODD[0]), _stir(two + w, _ODD[1])
        else:
            one[live], two[live] = _stir(one[live] ^ w, _ODD[0]), _stir(two[live] + w, _ODD[1])
        more = np.flatnonzero(left > 8)
        at, left, live = at[more] + 8, left[more] - 8, more if live is None else live[more]
    return one, two


def _stir(h: np.ndarray, odd: np.uint64) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * odd
    return h ^ (h >> np.uint64(32))


def _after_wide_space(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each position is white space beyond ASCII."""
    out = np.zeros(len(at), bool)
    high = np.flatnonzero(buf[at - 1] >= 0x80)
    a, b, c = (buf[at[high] - k] for k in (1, 2, 3))  # a lead byte stands two or three back, so never before the buffer
    general = ((a >= 0x80) & (a <= 0x8A)) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF)
    out[high] = (
        (b == 0xC2) & ((a == 0x85) | (a == 0xA0))
        | (c == 0xE1) & (b == 0x9A) & (a == 0x80)
        | (c == 0xE2) & (b == 0x80) & general
        | (c == 0xE2) & (b == 0x81) & (a == 0x9F)
        | (c == 0xE3) & (b == 0x80) & (a == 0x80)
    )
    return out


class Slots:
    """Open addressing from two hashes to a row number, all keys of a call at a time."""

    def __init__(self, bits: int = 14):
        self.bits, self.held = bits, 0
        self.one, self.two = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.row = np.full(1 << bits, -1, np.int64)

    def _home(self, one: np.ndarray) -> np.ndarray:
        return (one >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The rows, -1 where a key is not held."""
        out = np.full(len(one), -1, np.int64)
        todo, at = np.arange(len(one)), self._home(one)
        while len(todo):
            row = self.row[at]
            hit = (row >= 0) & (self.one[at] == one[todo]) & (self.two[at] == two[todo])
            out[todo[hit]] = row[hit]
            on = (row >= 0) & ~hit
            todo, at = todo[on], (at[on] + 1) & (len(self.row) - 1)
        return out

    def add(self, one: np.ndarray, two: np.ndarray, rows: np.ndarray) -> None:
        """Distinct keys that are not held yet."""
        while (self.held + len(rows)) * 2 > len(self.row):
            old = self.row >= 0
            keys = self.one[old], self.two[old], self.row[old]
            self.__init__(self.bits + 1)
            self._place(*keys)
        self._place(one, two, rows)

    def _place(self, one, two, rows) -> None:
        self.held += len(rows)
        todo, at = np.arange(len(rows)), self._home(one)
        while len(todo):
            free = self.row[at] < 0
            spot, who = at[free], todo[free]
            self.row[spot] = rows[who]  # where two meet, one stays
            won = self.row[spot] == rows[who]
            self.one[spot[won]], self.two[spot[won]] = one[who[won]], two[who[won]]
            todo = np.concatenate((todo[~free], who[~won]))
            at = np.concatenate((at[~free], spot[~won])) + 1 & len(self.row) - 1


class Ragged:
    """Growing rows of integers: flat values and the bounds of the rows."""

    def __init__(self):
        self.flat, self.first, self.n = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int64), 0

    def extend(self, rows: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        used = int(self.first[self.n])
        ends = used + np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else used
        while len(self.flat) < total:
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while len(self.first) < self.n + len(rows) + 1:
            self.first = np.concatenate((self.first, np.zeros_like(self.first)))
        self.flat[used:total] = np.fromiter((i for row in rows for i in row), np.int32, total - used)
        self.first[self.n + 1 : self.n + 1 + len(rows)] = ends
        self.n += len(rows)

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of the given rows end to end, and their bounds."""
        sizes = self.first[rows + 1] - self.first[rows]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return self.flat[np.repeat(self.first[rows] - ends[:-1], sizes) + np.arange(ends[-1])], ends


class ChunkTable:
    """Ids of whole texts by ``encoders``, each from a list of chunks (bytes, the leading space included) to their ids."""

    def __init__(self, *encoders: Callable[[list[bytes]], list[list[int]]]):
        self.encoders = encoders
        self.forget()

    def forget(self) -> None:
        self.slots, self.ids = Slots(), [Ragged() for _ in self.encoders]

    def rows(self, chunked: Chunked) -> np.ndarray:
        """The table's row of every chunk; new chunks are encoded."""
        if self.ids[0].n > MOST_CHUNKS or sum(int(r.first[r.n]) for r in self.ids) > MOST_IDS:
            self.forget()
        one, two = chunked.hashes()
        rows = self.slots.find(one, two)
        new = np.flatnonzero(rows < 0)
        if len(new):
            number: dict[bytes, int] = {}
            raw, base = chunked.raw, self.ids[0].n
            own = np.fromiter((number.setdefault(raw[s:e], len(number)) for s, e in zip(chunked.start[new].tolist(), chunked.end[new].tolist())), np.int64, len(new))
            fresh = list(number)
            for ids, encode in zip(self.ids, self.encoders):
                ids.extend(encode(fresh))
            rows[new] = base + own
            _, at = np.unique(own, return_index=True)
            self.slots.add(one[new[at]], two[new[at]], base + own[at])
        return rows

    def encode(self, texts: list[str]) -> tuple[Chunked, list[tuple[np.ndarray, np.ndarray]]]:
        """For each encoder all ids end to end, and the bounds of the texts in them."""
        chunked = Chunked(texts)
        rows = self.rows(chunked)
        out = []
        for ids in self.ids:
            flat, ends = ids.gather(rows)
            out.append((flat, ends[chunked.bounds]))
        return chunked, out
