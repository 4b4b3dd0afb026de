"""Fuzzy line deduplication by MinHash.

A line's set holds the hashes of its shingles of Q characters, one at every
character (the last ones are shorter).  Native functions cannot build these sets
within the budget, so numpy does in tasks, over Arrow's own buffers.  One
permutation gives the signature: the smallest hash in each of BANDS * ROWS equal
ranges of the hash space, an empty range taking the value of the next filled one.
Every ROWS values make a band key; lines with Jaccard 0.8 share one of the 12
with a probability of 0.998.  Lines of at most SHORT shingles, where ranges run
empty, have each three neighbours among their KEEP smallest hashes as keys, too
(0.998 by these alone; two neighbours found no more and made four times as many
entries of long lists), and sets of at most TINY shingles each two.

Lists of at most LIST lines give all their pairs, longer ones a star around their
smallest id.  A parity bitmap of each set then rules pairs out without loss: two
bitmaps differ in no more bits than the sets in shingles, and sets at Jaccard 0.8
differ in at most a ninth of their added sizes.  The other pairs are verified on
whole sets and contracted to components.  Then long lists are compared in full,
but for lines of one component: up to LONG lines by a join under the same bitmaps,
whose pairs are verified like the first; longer ones, those outside the largest
component against all, in blocks dealt to tasks, by bitmaps and, where these allow
a link, on whole sets.  Connected components by star contraction keep their first line.

A line is identified by a 64-bit hash; equal lines collapse before anything else.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from riselens.llm.components import connected_components, merge_components
from riselens.llm.minhash_dedup import BLOCK, _tile
from riselens.llm.textbuf import _BYTE, _P, _power, mix
from riselens.session import checkpoint, configure, drop_checkpoint

Q, LIST, PERCENT = 5, 16, 80
BANDS, ROWS, SHORT, KEEP, TINY = 12, 4, 96, 16, 5
#: Lines of a list up to which a join compares it in full: a line meets fewer than that many others.
LONG = 256
#: 64-bit words of a set's parity bitmap, and lines of a block whose bitmaps are compared.
WORDS, WIDE = 8, 4096
#: Bytes and number of the lines worked on at once, fewer than 2^20; one line alone may have more bytes.
SLICE, LINES = 1 << 18, 4096


def shingles(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct 44-bit shingle hashes of each line of UTF-8 bytes, end to end, and the lines' bounds in them."""
    start = (buf & 0xC0) != 0x80
    start[bounds[:-1]] = True
    first = np.flatnonzero(start)
    at = np.searchsorted(first, bounds)
    pos, inv = _power(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * pos[:-1], dtype=np.uint64, out=total[1:])
    total = total[np.append(first, len(buf))]
    h = np.empty(len(first), np.uint64)
    whole = max(len(first) - Q + 1, 0)
    np.subtract(total[Q:], total[:whole], out=h[:whole])
    for left in range(1, Q):
        last = at[1:] - left
        own = last >= at[:-1]
        h[last[own]] = total[at[1:][own]] - total[last[own]]
    h *= inv[first]
    line = np.arange(len(bounds) - 1, dtype=np.uint64) << np.uint64(44)
    key = np.sort(np.repeat(line, np.diff(at)) | mix(h) >> np.uint64(20))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    ends = np.searchsorted(key, np.arange(len(bounds), dtype=np.uint64) << np.uint64(44))
    ends[-1] = len(key)
    return (key & np.uint64(2**44 - 1)).view(np.int64), ends


def _text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of lines, and their bounds."""
    column = column.cast(pa.large_string())
    return np.frombuffer(column.buffers()[2], np.uint8), np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]


def _slices(bounds: np.ndarray):
    lo = 0
    while lo < len(bounds) - 1:
        hi = max(lo + 1, min(lo + LINES, int(np.searchsorted(bounds, bounds[lo] + SLICE, "right")) - 1))
        yield lo, hi
        lo = hi


def band_keys(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The band keys of each line's sorted shingle hashes, end to end, and the lines' bounds in them."""
    n, v, bins = np.diff(ends), values.view(np.uint64), BANDS * ROWS
    line = np.repeat(np.arange(len(n)), n)
    cell = (v * np.uint64(bins) >> np.uint64(44)).astype(np.int64) + line * bins
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    at = np.full((len(n), bins), -1)
    at.ravel()[cell[first]] = first
    filled = np.where(at >= 0, np.arange(bins), 2 * bins)
    following = np.minimum.accumulate(np.concatenate((filled, filled + bins), 1)[:, ::-1], 1)[:, ::-1][:, :bins]
    least = v[np.take_along_axis(at, following % bins, 1)]
    least = (least + (following - np.arange(bins)).astype(np.uint64) * _P).reshape(len(n), BANDS, ROWS)
    band = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), least.shape[:2])
    for row in range(ROWS):
        band = mix(band * _P + least[:, :, row])

    at = np.flatnonzero(np.repeat(n <= SHORT, n))
    rank, size = at - ends[line[at]], n[line[at]]
    two, three = (rank < size - 1) & (size <= TINY), rank < np.minimum(size, KEEP) - 2
    (twos, of_two), (threes, of_three) = ((at[x], rank[x]) for x in (two, three))
    of_twos, of_threes = (np.bincount(line[x], minlength=len(n)) for x in (twos, threes))
    bounds = np.concatenate(([0], np.cumsum(BANDS + of_twos + of_threes)))
    keys = np.empty(bounds[-1], np.uint64)
    keys[bounds[:-1, None] + np.arange(BANDS)] = band
    keys[(bounds[:-1] + BANDS)[line[twos]] + of_two] = mix(mix(v[twos]) + v[twos + 1])
    keys[(bounds[:-1] + BANDS + of_twos)[line[threes]] + of_three] = mix(mix(mix(v[threes]) + v[threes + 1]) + v[threes + 2])
    return keys.view(np.int64), bounds


def parity(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each set WORDS words: bit i of them is the parity of the hashes with remainder i."""
    n = np.diff(ends)
    bit = np.repeat(np.arange(len(n)) * 64 * WORDS, n) + values % (64 * WORDS)
    odd = np.bincount(bit, minlength=len(n) * 64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").reshape(len(n), WORDS)


def with_keys(lines: DataFrame) -> DataFrame:
    """n, the size of the line's set, its band keys and its parity bitmap, in place of the column line."""
    others = [c for c in lines.columns if c != "line"]
    schema = StructType([*lines.select(others).schema.fields]).add("n", IntegerType()).add("keys", ArrayType(LongType())).add("bits", ArrayType(LongType()))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data, bounds = _text(batch.column(batch.schema.get_field_index("line")))
            for lo, hi in _slices(bounds):
                values, ends = shingles(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
                keys, at = band_keys(values, ends)
                keys = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys))
                bits = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * WORDS, pa.int32()), pa.array(parity(values, ends).ravel()))
                columns = [batch.column(batch.schema.get_field_index(c)).slice(lo, hi - lo) for c in others]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(ends), pa.int32()), keys, bits], [*others, "n", "keys", "bits"])

    return lines.mapInArrow(run, schema)


def _linked(batches):
    """Of pairs (a, b, x, y) with the texts of their lines those at PERCENT."""
    for batch in batches:
        if not batch.num_rows:
            continue
        (dx, bx), (dy, by) = (_text(batch.column(batch.schema.get_field_index(c))) for c in "xy")
        keep = []
        for lo, hi in _slices(bx + by):
            (vx, ex), (vy, ey) = (shingles(d[b[lo] : b[hi]], b[lo : hi + 1] - b[lo]) for d, b in ((dx, bx), (dy, by)))
            nx, ny = np.diff(ex), np.diff(ey)
            pair = np.arange(hi - lo)
            both = np.sort(np.concatenate((np.repeat(pair, nx) << 44 | vx, np.repeat(pair, ny) << 44 | vy)))
            same = np.bincount(both[1:][both[1:] == both[:-1]] >> 44, minlength=hi - lo)
            keep.append(100 * same >= PERCENT * (nx + ny - same))
        yield batch.select(["a", "b"]).filter(pa.array(np.concatenate(keep)))


def split_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of every line with a word, of rows with an id."""
    lines = docs.where("doc_id is not null and text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def _sizes_fit(x: str, y: str) -> str:
    return f"100 * least({x}, {y}) >= {PERCENT} * greatest({x}, {y})"


def _bitmaps_fit(x: str, y: str, bits_x: str, bits_y: str) -> str:
    differ = " + ".join(f"bit_count({bits_x}[{w}] ^ {bits_y}[{w}])" for w in range(WORDS))
    return f"{100 + PERCENT} * ({differ}) <= {100 - PERCENT} * ({x} + {y})"


def _shared(reps: DataFrame) -> DataFrame:
    """(key, id, n, c, pivot): the entries of the lists of two lines or more, with the list's length and smallest id.

    Lists of two lines whose sizes allow no link are left out.
    """
    # dealt by key once, for the lists and the join: both take the same columns
    entries = reps.select(F.explode("keys").alias("key"), "id", "n").repartition("key")
    lists = entries.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("pivot"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    lists = lists.where("c > 2 or c = 2 and " + _sizes_fit("lo", "hi")).select("key", "c", "pivot")
    # most keys have one entry: the lists are the small side, and the entries are not sorted for them
    return entries.join(lists.hint("shuffle_hash"), "key")


def _pairs(shared: DataFrame, reps: DataFrame) -> DataFrame:
    """Candidate pairs (a < b) that sizes and bitmaps allow."""
    star = shared.where(F.col("c") > LIST).where("id <> pivot").select("id", "pivot")
    # a list of two is its pivot and the other line, of sizes that fit
    two = shared.where((F.col("c") == 2) & (F.col("c") <= LIST)).where("id <> pivot").select("id", "pivot")
    small = shared.where((F.col("c") > 2) & (F.col("c") <= LIST)).select("key", "id", "n")
    other = small.select("key", F.col("id").alias("pivot"), F.col("n").alias("pn"))
    full = small.join(other, "key").where("id < pivot and " + _sizes_fit("n", "pn")).select("id", "pivot")
    pairs = star.union(two).union(full).select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    for side in "ab":
        pairs = pairs.join(reps.select(F.col("id").alias(side), F.col("n").alias("n" + side), F.col("bits").alias("bits" + side)), side)
    return pairs.where(_sizes_fit("na", "nb") + " and " + _bitmaps_fit("na", "nb", "bitsa", "bitsb")).select("a", "b")


def _lines(docs: DataFrame, reps: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts (id, line) of the named lines: a few times shorter than their sets."""
    places = ids.join(reps.select("id", "first.doc_id", "first.line_no"), "id").groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "id")).alias("at"))
    texts = docs.select("doc_id", "text").where("text is not null").join(places, "doc_id")
    lines = texts.select(F.split("text", "\n", -1).alias("l"), "at").select(F.explode(F.transform("at", lambda a: F.struct(a["id"].alias("id"), F.get("l", a["line_no"]).alias("line")))).alias("x"))
    return checkpoint(lines.select("x.id", "x.line").where(F.xxhash64("line") == F.col("id")).dropDuplicates(["id"]))


def _verify(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    both = pairs.join(lines.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(lines.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_linked, "a long, b long")


def _tiles(rows: DataFrame, block: int, compare, schema: str) -> DataFrame:
    """``compare`` over blocks of each key's rows (key, comp, id, ...): those outside the largest comp against all, dealt to tasks."""
    per = rows.groupBy("key", "comp").agg(F.count("*").alias("c"))
    sizes = per.groupBy("key").agg(F.sum("c").alias("all"), F.max(F.struct("c", "comp")).alias("main")).where(F.col("all") > F.col("main.c"))
    blocks = {"of_all": F.ceil(F.col("all") / block).cast("int"), "of_rest": F.ceil((F.col("all") - F.col("main.c")) / block).cast("int")}
    own, rows = rows.columns, rows.join(sizes.withColumns(blocks).select("key", "of_all", "of_rest", F.col("main.comp").alias("main")), "key")
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where("comp <> main").select(*own, place("of_rest").alias("i"), every("of_all").alias("j"))
    right = rows.select(*own, every("of_rest").alias("i"), place("of_all").alias("j"))
    right = right.toDF(*(c + "_r" for c in right.columns))
    names = [x.split()[0] for x in schema.split(",")]

    def run(lt: pd.DataFrame, rt: pd.DataFrame) -> pd.DataFrame:
        if lt.empty or rt.empty:
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in names})
        return compare(lt, rt.rename(columns=lambda c: c.removesuffix("_r")))

    return left.groupBy("key", "i", "j").cogroup(right.groupBy("key_r", "i_r", "j_r")).applyInPandas(run, schema)


def _open(lt: pd.DataFrame, rt: pd.DataFrame) -> pd.DataFrame:
    """The rows of two blocks that sizes and bitmaps allow a link with a row of another component."""
    (x, y), (nx, ny) = ((np.array(t["bits"].tolist(), np.int64).T for t in (lt, rt)), (t["n"].to_numpy(np.int64) for t in (lt, rt)))
    cx, cy = lt["comp"].to_numpy(), rt["comp"].to_numpy()
    of_x, of_y = np.zeros(len(lt), bool), np.zeros(len(rt), bool)
    for lo in range(0, len(lt), 256):
        at = slice(lo, lo + 256)
        differ = np.zeros((len(nx[at]), len(ny)), np.uint16)
        for w in range(WORDS):
            differ += np.bitwise_count((x[w, at, None] ^ y[w, None, :]).view(np.uint64))
        n, m = nx[at, None], ny[None, :]
        may = ((100 + PERCENT) * differ.astype(np.int64) <= (100 - PERCENT) * (n + m)) & (cx[at, None] != cy[None, :])
        may &= 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)
        of_x[at], of_y = may.any(1), of_y | may.any(0)
    return pd.concat((lt.loc[of_x, ["key", "id"]], rt.loc[of_y, ["key", "id"]]))


def _links(lt: pd.DataFrame, rt: pd.DataFrame) -> pd.DataFrame:
    """Links between the components of two blocks, on the lines' whole sets."""

    def members(block: pd.DataFrame) -> pd.DataFrame:
        values, ends = shingles(*_text(pa.array(block["line"], pa.large_string())))
        return block.rename(columns={"id": "rep"}).assign(members=np.split(values, ends[1:-1]))

    return _tile(members(lt), members(rt), PERCENT)


def _rest(docs: DataFrame, reps: DataFrame, entries: DataFrame, comp: DataFrame) -> DataFrame | None:
    """Links within long lists between lines that ``comp`` leaves apart; None if there can be none.

    Bitmaps first tell the pairs, or in the longest lists the lines, that may have any; only their texts are fetched.
    """
    rows = entries.join(comp, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("comp"))
    apart = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).where("lo <> hi")
    rows = rows.join(apart.select("key", "c"), "key")
    rows = checkpoint(rows.join(reps.select("id", "bits"), "id"))
    if rows.isEmpty():
        return None
    x, y = (rows.where(F.col("c") <= LONG).select("key", *(F.col(c).alias(c + s) for c in ("id", "n", "comp", "bits"))) for s in "12")
    fit = " and ".join(("id1 < id2", "comp1 <> comp2", _sizes_fit("n1", "n2"), _bitmaps_fit("n1", "n2", "bits1", "bits2")))
    pairs = checkpoint(x.join(y, "key").where(fit).select(F.col("id1").alias("a"), F.col("id2").alias("b")).distinct())
    long = rows.where(F.col("c") > LONG).drop("c")
    open_ = checkpoint(_tiles(long, WIDE, _open, "key long, id long").distinct())
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).union(open_.select("id")).distinct()
    lines = _lines(docs, reps, ids)
    texts = long.select("key", "id", "comp").join(open_, ["key", "id"], "left_semi").join(lines, "id")
    links = checkpoint(_verify(pairs, lines).union(_tiles(texts, BLOCK, _links, "a long, b long")))
    for written in (rows, pairs, open_, lines):
        drop_checkpoint(written)
    return links


def line_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line_id, kept, first_doc_id, first_line_no) of every line with a word.

    kept: the line is its component's first by doc_id and line number, which the
    last two columns give.  Blank lines and rows with a null id or text have no
    line here and are never touched.  Rows that share a doc_id are one document:
    repeated rows give equal lines at equal places, all kept or all dropped.  An
    empty table gives an empty one; extra columns are ignored.
    """
    configure(docs.sparkSession)
    src = split_lines(docs).withColumn("id", F.xxhash64("line"))
    lines = checkpoint(src.select("doc_id", "line_no", "id"))
    # equal lines collapse before their sets are built
    distinct = src.groupBy("id").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.first("line").alias("line"))
    reps = checkpoint(with_keys(distinct))
    shared = checkpoint(_shared(reps))
    pairs = checkpoint(_pairs(shared, reps))
    texts = _lines(docs, reps, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    links = checkpoint(_verify(pairs, texts))
    drop_checkpoint(texts)
    drop_checkpoint(pairs)
    comp = checkpoint(connected_components(links))
    rest = _rest(docs, reps, shared.where(F.col("c") > LIST).select("key", "id", "n"), comp)
    if rest is not None:
        comp = checkpoint(merge_components(comp, rest))
    drop_checkpoint(shared)
    of_comp = comp.join(reps.select("id", "first"), "id").groupBy("component").agg(F.min("first").alias("keeper"))
    keepers = comp.join(of_comp, "component").select("id", "keeper")
    by_line = reps.select("id", "first").join(keepers, "id", "left").select("id", F.coalesce("keeper", "first").alias("f"))
    out = lines.select("doc_id", "line_no", "id").join(by_line, "id")
    kept = (F.col("doc_id") == F.col("f.doc_id")) & (F.col("line_no") == F.col("f.line_no"))
    return out.select("doc_id", "line_no", F.col("id").alias("line_id"), kept.alias("kept"), F.col("f.doc_id").alias("first_doc_id"), F.col("f.line_no").alias("first_line_no"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with every dropped line cut out of its text; no row is lost, all columns stay."""
    dropped = line_classes(docs).where("not kept").groupBy("doc_id").agg(F.collect_set(F.struct(F.col("line_no").alias("i"), F.col("line_id").alias("h"))).alias("_dropped"))
    joined = docs.join(dropped, "doc_id", "left")
    # a list per document: its own lines only
    kept = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(x.alias("x"), i.alias("i"), F.xxhash64(x).alias("h"))), lambda s: ~F.array_contains("_dropped", F.struct(s["i"].alias("i"), s["h"].alias("h"))))
    text = F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda s: s["x"]), "\n"))
    return joined.withColumn("text", text).select(*docs.columns)
