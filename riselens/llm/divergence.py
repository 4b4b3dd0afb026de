"""Divergence of the sources of a language, over terms found by iceberg prefix refinement.

The kept terms of a language are those in enough of its documents.  They are
found without counting the long tail: a level counts, for byte prefixes of one
length, the documents that hold a term with that prefix, and the next level goes
on only below prefixes that reach the threshold, since no term can be in more
documents than its prefix.  A term ends with a byte of its own, so at its level
a complete term is a prefix like any other, and those that reach the threshold
there are kept.

Documents are disjoint between tasks, so their counts of a prefix add up, and
what is shuffled at a level are the distinct prefixes of batches.  Survivors go
to the next level as a Bloom filter of fixed size, whatever their number: a
prefix let through by mistake is counted once more and fails its own threshold.
All counts that decide are exact sums per (language, prefix).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riselens.llm.chunks import pieces_of, span_hashes
from riselens.llm.textbuf import mix
from riselens.session import checkpoint, configure

LEAST_DOCS = 30
TOP = 50
#: Bits of the filter that carries survivors, and byte length of the first prefixes.
FILTER_BITS = 1 << 25
FIRST = 4
#: Characters of document terms that are counted together before they leave a worker.
TERM_LIMIT = 3_000_000
#: Cells of the (terms x sources) matrix that one task of the pair sums holds.
CELLS = 1 << 16
ONE = 1_000_000_000
_END = 0x20  # ends every term: no term holds it
_TERM = np.ones(256, bool)
_TERM[:0x80] = False
_TERM[0x41:0x5B] = _TERM[0x61:0x7B] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _hash(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hashes(raw, start, end - start)[0]


def _bits(h: np.ndarray, lang: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a (language, prefix) in a filter of ``size`` bits, a power of two."""
    one, last = mix(h ^ lang), np.uint64(size - 1)
    return (one & last).astype(np.int64), (one >> np.uint64(32) & last).astype(np.int64)


def _held(words: np.ndarray, h: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """Whether the filter (32 bits a word) lets each (language, prefix) through."""
    one, two = _bits(h, lang, 32 * len(words))
    return ((words[one >> 5] >> (one & 31).astype(np.uint32)) & (words[two >> 5] >> (two & 31).astype(np.uint32)) & np.uint32(1)).view(np.int32) > 0


def _lang_hash(names: list[str]) -> np.ndarray:
    """A hash of each name that every worker computes alike."""
    known: dict[str, np.uint64] = {}
    for name in set(names):
        raw = name.encode() + b"\0"
        known[name] = mix(_hash(raw, np.array([0]), np.array([len(raw)])))[0]
    return np.array([known[n] for n in names], np.uint64)


def _codes(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the distinct keys, and the first place of each."""
    code, values = pd.factorize(key)
    first = np.empty(len(values), np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    return code, first


def _spans(raw: bytes, start: np.ndarray, end: np.ndarray) -> pa.BinaryArray:
    """The bytes of the given spans as Arrow values."""
    at = np.concatenate(([0], np.cumsum(end - start)))
    flat = np.frombuffer(raw, np.uint8)[np.repeat(start - at[:-1], end - start) + np.arange(at[-1])]
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(flat)])


def _texts(kind: pa.DataType, at: np.ndarray, flat: pa.Buffer) -> pa.Array:
    return pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), flat])


def _document_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every text its distinct terms, each ended by a space, and how often each occurs."""
    for batch, texts in pieces_of(batches):
        coded = [t.encode() for t in texts]
        at = np.cumsum([0, *(len(c) + 1 for c in coded)])
        buf = _LOWER[np.frombuffer(b" ".join(coded) + b" ", np.uint8)]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], _TERM[buf], [False])).view(np.int8)))
        start, end = edge[::2], edge[1::2]
        doc = np.searchsorted(at, start, "right") - 1
        raw = buf.tobytes()
        term, terms = pd.factorize(_hash(raw, start, end))
        own, first = _codes(doc * len(terms) + term)  # numbered as they occur, so by text
        counts = np.bincount(own, minlength=len(first)).astype("<i4")
        bounds = np.searchsorted(first, np.searchsorted(start, at))
        upto = np.concatenate(([0], np.cumsum(end[first] - start[first] + 1)))
        buf[end[first]] = _END  # what ends a term is no part of another
        terms = _spans(buf.tobytes(), start[first], end[first] + 1).buffers()[2]
        columns = [_texts(pa.string(), upto[bounds], terms), _texts(pa.binary(), 4 * bounds, pa.py_buffer(counts))]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("source"), *columns], ["lang", "source", "text", "counts"])


def document_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, text, counts) per row of ``docs``: the distinct terms, ended by spaces, and 32-bit counts."""
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return named.mapInArrow(_document_terms, "lang string, source string, text string, counts binary")


class _Terms:
    """The terms of a batch of documents, and those of them that a filter lets through."""

    def __init__(self, batch: pa.RecordBatch, texts: list[str], survivors: np.ndarray | None, length: int):
        coded = [t.encode() for t in texts]
        at = np.cumsum([0, *map(len, coded)])
        self.raw = b"".join(coded)
        buf = np.frombuffer(self.raw, np.uint8)
        ends = np.flatnonzero(buf == _END) + 1
        start = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        doc = np.searchsorted(at, start, "right") - 1
        lang = _lang_hash(batch.column("lang").to_pylist())
        self.at = np.arange(len(start))
        if survivors is not None:
            longer = np.flatnonzero(ends - start > length)
            self.at = longer[_held(survivors, _hash(self.raw, start[longer], start[longer] + length), lang[doc[longer]])]
        self.start, self.end, self.doc = start[self.at], ends[self.at], doc[self.at]
        self.lang = lang[self.doc]


def _merged(batches: Iterator[pa.RecordBatch], most: int = 400_000) -> Iterator[pa.RecordBatch]:
    """Counts ``n`` of equal keys of neighbouring batches added up, ``most`` rows at a time."""
    held, rows = [], 0

    def settle():
        keys = held[0].schema.names[:-1]
        sums = pa.Table.from_batches(held).group_by(keys, use_threads=False).aggregate([("n", "sum")])
        return sums.select([*keys, "n_sum"]).rename_columns([*keys, "n"]).to_batches()

    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= most:
            yield from settle()
            held, rows = [], 0
    if held:
        yield from settle()


def _prefix_counts(survivors, length: int, upto: int):
    """(lang, prefix, n): documents that hold a term with the prefix of ``upto`` bytes, below survivors of ``length`` bytes, by batches."""

    def counted(batches):
        words = None if survivors is None else survivors.value
        for batch, texts in pieces_of(batches, TERM_LIMIT):
            t = _Terms(batch, texts, words, length)
            if not len(t.start):
                continue
            end = np.minimum(t.end, t.start + upto)
            prefix, first = _codes(_hash(t.raw, t.start, end) ^ t.lang)
            n = np.bincount(pd.unique(t.doc * len(first) + prefix) % len(first), minlength=len(first))
            lang = batch.column("lang").take(pa.array(t.doc[first]))
            yield pa.RecordBatch.from_arrays([lang, _spans(t.raw, t.start[first], end[first]), pa.array(n, pa.int64())], ["lang", "prefix", "n"])

    return lambda batches: _merged(counted(batches))


def _filter(prefixes: DataFrame):
    """The prefixes (lang, prefix) as a broadcast filter of FILTER_BITS bits; None if there are none."""
    size = FILTER_BITS

    def run(batches):
        for batch in batches:
            names = batch.column("prefix").to_pylist()
            end = np.cumsum([len(x) for x in names], dtype=np.int64)
            start = np.concatenate(([0], end[:-1]))
            places = np.concatenate(_bits(_hash(b"".join(names), start, end), _lang_hash(batch.column("lang").to_pylist()), size))
            yield pa.RecordBatch.from_arrays([pa.array(places >> 5), pa.array(1 << (places & 31))], ["word", "bit"])

    words = prefixes.select("lang", "prefix").mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    if not len(words):
        return None
    held = np.zeros(size // 32, np.uint32)
    held[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return prefixes.sparkSession.sparkContext.broadcast(held)


def kept_terms(terms: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term) of the terms in at least ``least`` documents, from rows of ``document_terms``.

    Every level is written (its survivors only), and holds one row per prefix.
    """
    spark = terms.sparkSession
    found = spark.createDataFrame([], "lang string, term string")
    survivors, length, upto = None, 0, FIRST
    while True:
        counted = terms.select("lang", "text").mapInArrow(_prefix_counts(survivors, length, upto), "lang string, prefix binary, n long")
        level = checkpoint(counted.groupBy("lang", "prefix").agg(F.sum("n").alias("n")).where(F.col("n") >= least).drop("n"))
        complete = F.substring("prefix", -1, 1) == F.lit(bytes([_END]))
        term = F.expr("substring(prefix, 1, octet_length(prefix) - 1)").cast("string").alias("term")
        found = found.unionByName(level.where(complete).select("lang", term))
        survivors = _filter(level.where(~complete))
        if survivors is None:
            return found
        length, upto = upto, upto + max(3, upto // 2)


def _term_counts(survivors):
    """(lang, source, term, n): occurrences of the terms that the filter lets through, by batches."""

    def counted(batches):
        for batch, texts in pieces_of(batches, TERM_LIMIT):
            t = _Terms(batch, texts, None, 0)
            h = _hash(t.raw, t.start, t.end)
            some = np.flatnonzero(_held(survivors.value, h, t.lang))
            if not len(some):
                continue
            sources = batch.column("source").to_pylist()
            source, names = pd.factorize(np.array(sources, object))
            term, _ = pd.factorize(h[some] ^ t.lang[some])
            code, first = _codes(term * len(names) + source[t.doc[some]])
            weights = np.frombuffer(b"".join(batch.column("counts").to_pylist()), "<i4")[some]
            n = np.zeros(len(first), np.int64)
            np.add.at(n, code, weights)
            at = some[first]
            keys = [batch.column(c).take(pa.array(t.doc[at])) for c in ("lang", "source")]
            yield pa.RecordBatch.from_arrays([*keys, _spans(t.raw, t.start[at], t.end[at] - 1).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "source", "term", "n"])

    return lambda batches: _merged(counted(batches))


def _share(count: Column) -> Column:
    """The smoothed share of a term in a group of ``total`` occurrences among ``v`` terms, in billionths: exact integers."""
    wide = lambda c: c.cast("decimal(20,0)")
    top = wide(count + 5) * F.lit(ONE).cast("decimal(10,0)")
    return F.call_function("div", top, wide(F.col("total") + 5 * F.col("v"))) + 1


def _pair_sums(cells: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket of a language's terms: for every source the sums of differences to all others."""
    lang = (cells if len(cells) else groups)["lang"].iloc[0]
    names = groups["source"].to_numpy(object)
    empty = pd.DataFrame({"lang": pd.Series(dtype=str), "source": pd.Series(dtype=str), "item": pd.Series(dtype=str), "f": pd.Series(dtype="int64")})
    if not len(groups):
        return empty
    zero = groups["zero"].fillna(1).to_numpy(np.int64)
    place = {s: k for k, s in enumerate(names)}
    term, values = pd.factorize(cells["term"])
    p = np.repeat(zero[:, None], len(values), axis=1)
    p[[place[s] for s in cells["source"]], term] = cells["p"].to_numpy(np.int64)
    out = []
    for k, name in enumerate(names):
        rest = np.arange(len(names)) != k
        f = np.abs(p[rest] - p[k]).sum(axis=1) if len(values) else np.zeros(len(names) - 1, np.int64)
        out.append(pd.DataFrame({"lang": lang, "source": name, "item": names[rest], "f": f}))
    return pd.concat(out) if out else empty


def source_divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """Per (lang, source): its distance to every other source of the language, and its ``top`` terms above the language.

    Columns lang, source, part ("pair" or "term"), item, value, rank; see the
    README for the shares.  Null texts, languages and sources count as empty
    strings; sources without terms are groups like any other; repeated rows and
    doc_ids count row by row; equal values rank by the item's bytes; an empty
    table gives no row; extra columns are ignored.
    """
    spark = configure(docs.sparkSession)
    terms = checkpoint(document_terms(docs))
    kept = checkpoint(kept_terms(terms, least))
    survivors = _filter(kept.select("lang", F.concat(F.col("term").cast("binary"), F.lit(bytes([_END]))).alias("prefix")))
    if survivors is None:
        counts = spark.createDataFrame([], "lang string, source string, term string, n long")
    else:
        counts = terms.mapInArrow(_term_counts(survivors), "lang string, source string, term string, n long")
        counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")).join(kept, ["lang", "term"], "left_semi")
    counts = checkpoint(counts)
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = terms.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["total", "v"])
    many = F.ceil(F.col("v") * F.count("*").over(Window.partitionBy("lang")) / CELLS)
    zero = F.when(F.col("v") > 0, _share(F.lit(0).cast("long")))
    groups = checkpoint(groups.withColumns({"zero": zero, "buckets": F.greatest(many, F.lit(1)).cast("int")}))

    shares = counts.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n")))
    cells = shares.select("lang", "source", "term", "p", F.pmod(F.xxhash64("term"), "buckets").cast("int").alias("bucket"))
    spread = groups.select("lang", "source", "zero", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"))
    sums = cells.groupBy("lang", "bucket").cogroup(spread.groupBy("lang", "bucket")).applyInPandas(_pair_sums, "lang string, source string, item string, f long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("f").alias("value"))

    by_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    whole = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("v").alias("v"))
    q = by_lang.join(whole, "lang").select("lang", "term", _share(F.col("n")).alias("q"))
    above = shares.where("n > 0").join(q, ["lang", "term"]).where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    first = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", place.alias("rank"))
    return first(pairs, "pair").unionByName(first(above, "term").where(F.col("rank") <= top))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // (CAST(total AS HUGEINT) + 5 * v) AS p
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
l AS (SELECT lang, sum(total) AS total, max(v) AS v FROM g GROUP BY lang),
q AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (sum(n) + 5)) // (CAST(max(total) AS HUGEINT) + 5 * max(v)) AS q FROM c JOIN l USING (lang) GROUP BY ALL),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST(p - q AS BIGINT) AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
