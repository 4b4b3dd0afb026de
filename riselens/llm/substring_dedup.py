"""Repeated passages by content-defined chunks, extended byte by byte.

A gear hash rolls over the bytes of every text.  A chunk ends behind each byte whose
hash is the smallest of some WINDOW neighbours, and where the text ends, so chunks
have 32 bytes on average, none is much longer than WINDOW, and borders depend on the
bytes within WINDOW alone: an insertion moves the borders around it and no others.
All borders at least WINDOW bytes inside a passage are the same wherever it stands.

Chunks are grouped by a 96-bit digest; all but the first occurrence (by doc_id, then
place) are seeds, where WINDOW bytes or more on end are covered by them.  Two
occurrences of a passage of at least 5 * WINDOW + 15 (335) bytes always have so
many, shorter ones nearly always (of 3,000 samples of 51 words of ordinary sentences
one in a hundred had under 145 bytes, of 35 words under 69; a stretch that repeats a
word over and over matches at any of its places).  Neighbouring seeds at the same
distance from their first occurrences make a run.  Both texts' bytes before and
behind a run are compared, up to CONTEXT, as far as they agree: a longer agreement
has further chunks in it.  What is left of a word at either end goes.  The limit of
MIN_WORDS words applies to the extended run; overlapping runs of a document then
make one passage.  A chunk is compared with its first occurrence only, so a
passage whose chunks all stand earlier in other surroundings, each as a phrase of
under MIN_WORDS words, is not found.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riselens.llm.common import clean_docs
from riselens.llm.textbuf import _SPACE, Words, batches
from riselens.session import checkpoint, drop_checkpoint

WINDOW = 64
CONTEXT = 2 * WINDOW + 16
MIN_WORDS = 20
_REACH = 15  # bytes before its own that a gear hash of 16 bits depends on
_NONE = np.uint32(2**20)
_GEAR = np.random.Generator(np.random.PCG64(32)).integers(0, 2**16, 256, dtype=np.uint16)
_DIGEST = np.dtype([("d1", "<i8"), ("d2", "<i4")])


def gear(buf: np.ndarray) -> np.ndarray:
    """h(i) = 2 h(i - 1) + GEAR[b(i)] in 16 bits, by doubling the window four times."""
    h = _GEAR[buf]
    for step in (1, 2, 4, 8):
        h[step:] += h[:-step] << np.uint16(step)
    return h


def borders(buf: np.ndarray, text_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and text of the chunks of texts that lie end to end in ``buf``, a byte behind each; text_end includes it."""
    begin, last = np.concatenate(([0], text_end[:-1])), text_end - 1
    text = np.repeat(np.arange(len(text_end)), text_end - begin)
    place = np.arange(len(buf))
    value = gear(buf).astype(np.uint32) + np.uint32(1)
    value[(place - begin[text] < _REACH) | (place == last[text])] = _NONE
    least = value.copy()
    step = 1
    while step < WINDOW:
        np.minimum(least[:-step], least[step:], out=least[:-step])
        step *= 2
    least[(value == _NONE) | (place + WINDOW > last[text])] = 0  # windows stay inside a text
    step = 1
    while step < WINDOW:
        np.maximum(least[step:], least[:-step], out=least[step:])
        step *= 2
    kept = np.flatnonzero(value == least)
    if len(kept) > 2:  # a text that repeats itself has its smallest hash at even gaps: one for each window is enough
        gap = np.diff(kept)
        even = (value[kept[1:]] == value[kept[:-1]]) & (gap < WINDOW) & (text[kept[1:]] == text[kept[:-1]])
        middle = np.concatenate(([False], even[1:] & even[:-1] & (gap[1:] == gap[:-1]), [False]))
        at = np.arange(len(kept))
        since = at - np.maximum.accumulate(np.where(middle, 0, at))
        kept = kept[~middle | (since % np.concatenate(([1], np.maximum(WINDOW // gap, 1))) == 0)]
    edge = np.unique(np.concatenate((begin, kept + 1, last)))
    of = text[edge[:-1]]
    inside = edge[:-1] < last[of]
    return edge[:-1][inside], edge[1:][inside], of[inside]


def _chunks(frames):
    for pdf in batches(frames):
        raw = "".join(t + "\n" for t in pdf["text"]).encode("utf-8", "replace")
        sizes = [len(t.encode("utf-8", "replace")) + 1 for t in pdf["text"]]
        text_end = np.cumsum(sizes)
        s, e, of = borders(np.frombuffer(raw, np.uint8), text_end)
        if not len(s):
            continue
        d = np.frombuffer(b"".join(hashlib.blake2b(raw[i:j], digest_size=12).digest() for i, j in zip(s.tolist(), e.tolist())), _DIGEST)
        begin = np.concatenate(([0], text_end[:-1]))[of]
        yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[of], "start": s - begin, "size": e - s, "d1": d["d1"], "d2": d["d2"]})


PLACES = "doc_id long, start int, end int, first boolean, fd long, fs int, fe int, before binary, behind binary, ws int, we int, from0 int, from1 int, to0 int, to1 int"


def _surroundings(frames):
    """The bytes before and behind stretches of each text, one more than CONTEXT.

    The stretches are the text's runs, with the places fd, fs, fe of their first
    occurrences, and (first) such places in it.  ws, we: the words that begin before
    start, and that end up to end; from0, from1: the first two places from start on
    where a word begins, to0, to1: the last two up to end where one ends (-1: none).
    """
    for pdf in batches(frames):
        words = Words(pdf["text"].tolist())
        begin = np.concatenate(([0], words.text_end[:-1]))
        parts = []
        for k, (doc_id, starts, ends, fd, shift, first) in enumerate(zip(*(pdf[c] for c in ("doc_id", "starts", "ends", "fds", "shifts", "firsts")))):
            lo, hi, b, last = words.bounds[k], words.bounds[k + 1], begin[k], words.text_end[k] - 1
            s, e = np.minimum(b + starts, last), np.minimum(b + ends, last)
            ws, we = np.searchsorted(words.start[lo:hi], s), np.searchsorted(words.end[lo:hi], e, "right")
            begins = np.concatenate((words.start[lo:hi] - b, [-1, -1]))
            ended = np.concatenate(([-1, -1], words.end[lo:hi] - b))
            parts.append(pd.DataFrame({
                "doc_id": doc_id, "start": starts, "end": ends, "first": first, "fd": fd, "fs": starts - shift, "fe": ends - shift,
                "before": [words.raw[max(b, i - CONTEXT - 1) : i] for i in s.tolist()], "behind": [words.raw[i : min(last, i + CONTEXT + 1)] for i in e.tolist()],
                "ws": ws, "we": we, "from0": begins[ws], "from1": begins[ws + 1], "to0": ended[we + 1], "to1": ended[we]}))
        yield pd.concat(parts)


def _grown(near: bytes, other: bytes, n0: int, n1: int, at: int) -> tuple[int, int]:
    """How far the last whole word that both texts have reaches beyond a run's edge, and how many words lie there.

    near, other: the bytes beyond the edge in the two texts, nearest first; the edge is
    at ``at``, and n0, n1 are the nearest two word borders on its inner side.  Without a
    word beyond it the distance is that to such a border, negative, and the number is 0,
    or -1 where the word at the edge goes on in one of the texts.
    """
    n = min(len(near), len(other), CONTEXT)
    x, y = np.frombuffer(near, np.uint8), np.frombuffer(other, np.uint8)
    if near[:n] != other[:n]:
        n = int(np.argmax(x[:n] != y[:n]))
    # beyond the texts' own ends lies white space
    x, y = (np.concatenate((_SPACE[v[: n + 1]], [True])) for v in (x, y))
    whole = np.flatnonzero(~x[:n] & x[1 : n + 1] & y[1 : n + 1])
    if len(whole):
        return int(whole[-1]) + 1, len(whole)
    if n0 == at and not (x[0] and y[0]):
        return (-abs(n1 - at) if n1 >= 0 else 0), -1
    return (-abs(n0 - at) if n0 >= 0 else 0), 0


def _extend(frames):
    for pdf in frames:
        left = [_grown(a[::-1], b[::-1], *p) for a, b, *p in zip(pdf["before"], pdf["before2"], pdf["from0"], pdf["from1"], pdf["start"])]
        right = [_grown(a, b, *p) for a, b, *p in zip(pdf["behind"], pdf["behind2"], pdf["to0"], pdf["to1"], pdf["end"])]
        (left, begun), (right, ended) = (np.array(x, np.int64).reshape(-1, 2).T for x in (left, right))
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "start": pdf["start"] - left, "end": pdf["end"] + right, "ws": pdf["ws"] - begun, "we": pdf["we"] + ended, "fd": pdf["fd"]})


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Repeated passages: doc_id, start and size (UTF-8 bytes), words, first_doc_id, across.

    A row says that this stretch of doc_id occurs earlier, beginning in
    first_doc_id; across is true if any of it occurs in another document.  words
    counts the whole words in it.  Null and empty texts, and rows without doc_id,
    have no passage.  Rows that share a doc_id are read as one document, so
    repeated rows repeat nothing; where their texts differ, the smallest one
    gives the bytes around a stretch.  Ties between equal passages go to the
    smallest doc_id and start.  Extra columns are ignored; an empty table gives
    an empty one.
    """
    rows = clean_docs(docs).where("doc_id is not null")
    chunks = checkpoint(rows.mapInPandas(_chunks, "doc_id long, start int, size int, d1 long, d2 int"))
    found = chunks.groupBy("d1", "d2").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "start")).alias("f")).where("c > 1")
    found = found.select("d1", "d2", F.col("f.doc_id").alias("fd"), F.col("f.start").alias("fs"))
    seeds = chunks.join(found, ["d1", "d2"]).where("doc_id <> fd or start <> fs")
    seeds = seeds.select("doc_id", "fd", (F.col("start") - F.col("fs")).alias("shift"), "start", (F.col("start") + F.col("size")).alias("end"))
    doc = Window.partitionBy("doc_id").orderBy("start", "end", "fd", "shift")
    seeds = seeds.withColumn("island", F.sum(F.coalesce((F.col("start") > F.lag("end").over(doc)).cast("int"), F.lit(0))).over(doc))
    whole = Window.partitionBy("doc_id", "island")
    seeds = seeds.withColumn("length", F.max("end").over(whole) - F.min("start").over(whole)).where(F.col("length") >= WINDOW)
    w = Window.partitionBy("doc_id", "fd", "shift").orderBy("start", "end")
    seeds = seeds.withColumn("run", F.sum(F.coalesce((F.col("start") > F.lag("end").over(w)).cast("int"), F.lit(0))).over(w))
    runs = checkpoint(seeds.groupBy("doc_id", "fd", "shift", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run"))

    drop_checkpoint(chunks)

    firsts = runs.select(F.col("fd").alias("doc_id"), "fd", F.lit(0).alias("shift"), (F.col("start") - F.col("shift")).alias("start"), (F.col("end") - F.col("shift")).alias("end"), F.lit(True).alias("first"))
    # a list per document: places of its own text only
    places = runs.withColumn("first", F.lit(False)).unionByName(firsts.distinct()).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "fd", "shift", "first")).alias("at"))
    texts = rows.groupBy("doc_id").agg(F.min("text").alias("text"))
    texts = texts.join(places.select("doc_id", F.col("at.start").alias("starts"), F.col("at.end").alias("ends"), F.col("at.fd").alias("fds"), F.col("at.shift").alias("shifts"), F.col("at.first").alias("firsts")), "doc_id")
    around = checkpoint(texts.mapInPandas(_surroundings, PLACES))
    drop_checkpoint(runs)
    first = around.where("first").select(F.col("doc_id").alias("fd"), F.col("start").alias("fs"), F.col("end").alias("fe"), F.col("before").alias("before2"), F.col("behind").alias("behind2"))
    both = around.where("not first").join(first, ["fd", "fs", "fe"])
    long = both.mapInPandas(_extend, "doc_id long, start int, end int, ws int, we int, fd long").where(F.col("we") - F.col("ws") >= min_words)

    w = Window.partitionBy("doc_id").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    parts = long.withColumn("run", (F.col("start") > F.coalesce(before, F.lit(-1))).cast("int")).withColumn("run", F.sum("run").over(w))
    out = parts.groupBy("doc_id", "run").agg(
        F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("size"), (F.max("we") - F.min("ws")).alias("words"),
        F.min(F.struct("start", "fd")).alias("f"), F.max(F.col("fd") != F.col("doc_id")).alias("across"))
    return out.select("doc_id", "start", "size", "words", F.col("f.fd").alias("first_doc_id"), "across")


def remove_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) without the given stretches; borders inside a character drop it."""
    spans = passages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "size"))).alias("spans"))
    joined = docs.select("doc_id", "text").join(spans, "doc_id", "left")

    def cut(frames):
        for pdf in frames:
            texts = []
            for text, spans in zip(pdf["text"], pdf["spans"]):
                if text is not None and spans is not None:
                    raw, at, kept = text.encode(), 0, []
                    for s in spans:
                        kept.append(raw[at : s["start"]])
                        at = max(at, s["start"] + s["size"])
                    text = b"".join([*kept, raw[at:]]).decode("utf-8", "ignore")
                texts.append(text)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "text": texts})

    return joined.mapInPandas(cut, "doc_id long, text string")
