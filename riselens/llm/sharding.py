"""Minimax contiguous sharding of groups of equal texts, in DataFrame operations.

Groups of equal texts are atomic and ordered by the 64-bit hash of the text.
The smallest feasible capacity is found by binary search, each value checked
greedily.  The search reads sums over hash ranges, never single groups: cells of
2^52 hashes first, and only cells in which a cut may fall are opened further.  A
cell is taken as indivisible for an upper bound and as divisible for a lower
one; when both meet, capacity and cuts are exact.  The driver holds some
thousand sums at most, whatever the input.  A row's shard then follows from its
own hash and the cuts, without a join; only counts per block of rows are
shuffled to number the slots.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riselens.llm.common import clean_docs
from riselens.session import checkpoint

STEP = 12
BLOCK_BITS = 16


def _greedy(cells: list[tuple], capacity: int, shards: int, divisible: bool) -> list[int] | None:
    """Byte positions of the cuts if ``shards`` windows of ``capacity`` hold all; a cell is (first hash, shift, bytes, groups)."""
    ends = list(accumulate(c[2] for c in cells))
    at, cuts = 0, []
    for _ in range(shards):
        if at + capacity >= ends[-1]:
            return cuts
        k = bisect_right(ends, at + capacity)  # the first cell that doesn't end within the window
        start = ends[k] - cells[k][2]
        cut = at + capacity if divisible and cells[k][3] > 1 else start
        if cut <= at:
            return None
        at = cut
        cuts.append(at)
    return None


def _least(cells: list[tuple], shards: int, divisible: bool, low: int) -> int:
    high = sum(c[2] for c in cells)
    while low < high:
        mid = (low + high) // 2
        if _greedy(cells, mid, shards, divisible) is None:
            low = mid + 1
        else:
            high = mid
    return low


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """Capacity, and the first hash of every shard but the first; groups: (h, bytes), one row per hash."""

    def sums(rows: DataFrame, shift: int) -> list[tuple]:
        found = rows.groupBy(F.shiftright("h", shift).alias("k")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).collect()
        return [(r["k"] << shift, shift, int(r["b"]), r["n"]) for r in found]

    cells = sorted(sums(groups, 64 - STEP))
    if not cells:
        return 0, []
    while True:
        total = sum(c[2] for c in cells)
        low = _least(cells, shards, True, -(-total // shards))
        high = _least(cells, shards, False, low)
        if low == high:
            break
        ends = list(accumulate(c[2] for c in cells))
        opened = set()
        bounds = [c for c in (_greedy(cells, x, shards, d) for x, d in ((low, True), (high, True), (high, False))) if c]
        for cuts in zip(*(b + [total] * (shards - len(b)) for b in bounds)):
            first, last = bisect_right(ends, min(cuts) - 1), bisect_right(ends, max(cuts))
            opened |= {k for k in range(first, min(last + 1, len(cells))) if cells[k][3] > 1}
        opened |= {k for k, c in enumerate(cells) if c[3] > 1 and c[2] > low}
        by_shift: dict[int, list[int]] = {}
        for k in opened:
            by_shift.setdefault(cells[k][1], []).append(cells[k][0] >> cells[k][1])
        fresh = [c for shift, keys in by_shift.items() for c in sums(groups.where(F.shiftright("h", shift).isin(keys)), max(0, shift - STEP))]
        cells = sorted([c for k, c in enumerate(cells) if k not in opened] + fresh)
    starts = dict(zip(accumulate((c[2] for c in cells[:-1]), initial=0), (c[0] for c in cells)))
    return high, [starts[c] for c in _greedy(cells, high, shards, False)]


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    size: UTF-8 bytes of the text plus 1 (null: 1).  The law is ``bytes``: the
    largest shard is as small as any contiguous split of the ordered groups
    allows; grown_shard is null.  Null and empty texts are one group.  Rows with
    equal or null doc_ids are placed by their texts like all others, repeated
    rows keep a slot each.  With fewer groups than shards the last shards stay
    empty; an empty table stays empty; extra columns are ignored.
    """
    text = F.col("text")
    rows = clean_docs(docs).select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS).alias("block"),
    )
    rows = checkpoint(rows)
    groups = checkpoint(rows.groupBy("h").agg(F.sum("size").alias("bytes")))
    _, cuts = minimax_cuts(groups, shards)
    number = F.lit(0)
    for c in cuts:
        number = number + (F.col("h") >= F.lit(c)).cast("int")
    placed = rows.withColumn("shard", number)
    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("shard", "block", F.coalesce(before, F.lit(0)).alias("base"))
    slot = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "h"))
    out = placed.withColumn("r", slot).join(base, ["shard", "block"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("r") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
