"""Distributed global ranking (W3 and the rank buckets of E7/E8/E11), and order statistics.

``row_number()`` over an unpartitioned window moves every row into one task.
Instead the rows are sorted with a range-partitioned sort (Spark samples the
key so hot values are spread), each partition's row count is taken (one
number per partition, collected), and a row's global rank is its partition's
offset plus its position inside the partition.  The sorted frame is
checkpointed first so both passes see the same partitioning.

Quantiles need no ranks of all rows: ``select_ranks`` counts rows by cells of
the value range, and opens only the cells that hold a wanted position.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riselens.session import checkpoint


def global_rank(df: DataFrame, order: Sequence[str], out: str = "rank") -> DataFrame:
    """0-based rank by ``order`` (must be a total order for determinism)."""
    sorted_df = checkpoint(
        df.orderBy(*[F.col(c).asc_nulls_first() for c in order])
        .withColumns({"_pid": F.spark_partition_id(), "_mid": F.monotonically_increasing_id()})
    )
    counts = sorted_df.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0")).collect()
    offsets, run = {}, 0
    for r in sorted(counts, key=lambda r: r["_pid"]):
        offsets[r["_pid"]] = (run, r["_m0"])
        run += r["_n"]
    if not offsets:
        return sorted_df.drop("_pid", "_mid").withColumn(out, F.lit(0).cast("long"))
    off = F.create_map(*[x for pid, (o, _) in offsets.items() for x in (F.lit(pid), F.lit(o))])
    base = F.create_map(*[x for pid, (_, m0) in offsets.items() for x in (F.lit(pid), F.lit(m0))])
    rank = off[F.col("_pid")] + F.col("_mid") - base[F.col("_pid")]
    return sorted_df.withColumn(out, rank.cast("long")).drop("_pid", "_mid")


# ---------------------------------------------------------------------------
# Order statistics by selection: no sort and no rewrite of the rows
# ---------------------------------------------------------------------------

#: Distinct values of one cell that are ranked together; larger cells are divided further.
OPEN_VALUES = 100_000
#: Cells into which a large cell is divided in a round.
SPLIT = 1024
#: Wanted cells up to which they are broadcast to the rows (a few dozen bytes each).
MOST_CELLS = 200_000


def cell_of(v: Column) -> Column:
    """A number that never falls as ``v`` rises: sign, binary exponent and six more bits.

    Where the logarithm is off by a rounding error next to a power of two, both
    exponents lead to the same number.  Infinities and NaN (last) have their own.
    """
    size = F.abs(v)
    e = F.floor(F.log2(size))
    step = F.floor((size / F.pow(F.lit(2.0), e) - 1) * 64)
    cell = ((e + 1100) * 64 + step).cast("long")
    signed = F.when(v > 0, cell).otherwise(-cell)
    far = F.lit(1 << 40)
    return (F.when(F.isnan(v), far + 1).when(v == float("inf"), far).when(v == float("-inf"), -far)
            .when(v == 0, F.lit(0).cast("long")).otherwise(signed))


def _matched(a: DataFrame, b: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join on ``cols``; b's keys are renamed first, so b may be derived from a."""
    other = b.select(*[F.col(c).alias(f"_j{i}") for i, c in enumerate(cols)], *[c for c in b.columns if c not in cols])
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_j{i}")) for i, c in enumerate(cols)])
    return a.join(other, on, how).drop(*[f"_j{i}" for i in range(len(cols))])


def select_ranks(df: DataFrame, keys: Sequence[str], values: Sequence[str], ranks: Callable[[Column], list[Column]]) -> DataFrame:
    """Exact order statistics per group and column: keys..., ``column``, ``n``, ``at``.

    ``ranks(n)`` gives the wanted 0-based ranks among a group's n non-null
    values; ``at`` maps each to its value.  Two passes over the rows: one counts
    them by (group, column, cell), which says in which cells wanted ranks lie;
    the other counts the distinct values inside those cells only.  A hot value
    is one partial row per task in either.  A cell with more than OPEN_VALUES
    distinct values is divided by value until the wanted part is small enough.
    Null keys are a group; a group without values has no row.
    """
    keys = [*keys]
    own = [f"_k{i}" for i in range(len(keys))]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in values])
    named = [F.col(k).alias(o) for k, o in zip(keys, own)]
    rows = df.select(*named, F.explode(pairs).alias("p")) if len(values) > 1 else df.select(*named, pairs[0].alias("p"))
    rows = rows.select(*own, "p.column", "p.v").where("v IS NOT NULL").withColumn("cell", cell_of(F.col("v")))
    group = [*own, "column"]

    wanted = checkpoint(_holding(rows.groupBy(*group, "cell").agg(F.count(F.lit(1)).alias("m")), group, ["cell"], ranks))
    few = wanted.limit(MOST_CELLS + 1).count() <= MOST_CELLS
    by = [*group, "cell"]
    w = wanted.select(*by, "n", "before", "ranks")
    if few:
        inside = _matched(rows, F.broadcast(w.select(*by)), by, "left_semi")
        counts = inside.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("m"))
    else:  # as many cells as groups: hot values collapse before the join
        counts = rows.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("m"))
    table = checkpoint(_matched(counts, w, by).select(*by, "v", "m", "n", "before", "ranks"))

    while True:
        sizes = table.groupBy(*by).agg(F.count(F.lit(1)).alias("values"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        if (sizes.agg(F.max("values")).first()[0] or 0) <= OPEN_VALUES:
            break
        spans = sizes.where(F.col("values") > 1)
        j = _matched(table, spans.drop("values"), by, "left")
        part = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * SPLIT), F.lit(SPLIT - 1))
        parts = checkpoint(j.withColumn("part", F.coalesce(part, F.lit(0)).cast("long")).drop("lo", "hi"))
        sums = parts.groupBy(*by, "part", "n", "before", "ranks").agg(F.sum("m").alias("m"))
        run = F.sum("m").over(Window.partitionBy(*by).orderBy("part")) + F.col("before") - F.col("m")
        sums = sums.withColumn("start", run).withColumn("ranks", F.filter("ranks", lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("m"))))
        sums = sums.where(F.size("ranks") > 0).select(*by, "part", "n", F.col("start").alias("before"), "ranks")
        kept = _matched(parts.drop("n", "before", "ranks"), sums, [*by, "part"])
        table = checkpoint(kept.select(*group, F.xxhash64("cell", "part").alias("cell"), "v", "m", "n", "before", "ranks"))

    start = F.sum("m").over(Window.partitionBy(*by).orderBy("v")) + F.col("before") - F.col("m")
    hit = table.withColumn("start", start)
    hit = hit.withColumn("r", F.explode(F.filter("ranks", lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("m")))))
    out = hit.groupBy(*group).agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("r", "v"))).alias("at"))
    return out.select(*[F.col(o).alias(k) for k, o in zip(keys, own)], "column", "n", "at")


def _holding(counts: DataFrame, group: Sequence[str], order: Sequence[str], ranks) -> DataFrame:
    """The cells that hold wanted ranks, with the ranks, the group's size and the rows before the cell."""
    w = Window.partitionBy(*group)
    c = counts.withColumns({"n": F.sum("m").over(w), "before": F.sum("m").over(w.orderBy(*order)) - F.col("m")})
    inside = F.filter(F.array_distinct(F.array(*ranks(F.col("n")))), lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("m")))
    return c.withColumn("ranks", inside).where(F.size("ranks") > 0)


def _position(n: Column, p: float) -> tuple[Column, Column, Column]:
    """Ranks around the p-quantile of n values, and the way between them."""
    h = (n - 1) * F.lit(float(p))
    lo = F.floor(h).cast("long")
    return lo, F.least(lo + 1, n - 1).cast("long"), h - lo


def quantile_table(df: DataFrame, keys: Sequence[str], values: Sequence[str], probs: Sequence[float], prefix: str = "q") -> DataFrame:
    """Exact linear-interpolated quantiles (pandas ``quantile``) of all columns in one go.

    Output: keys..., ``column``, ``n``, ``{prefix}0 … {prefix}{k-1}`` in the order of ``probs``.
    """
    found = select_ranks(df, keys, values, lambda n: [r for p in probs for r in _position(n, p)[:2]])
    out = []
    for i, p in enumerate(probs):
        lo, hi, way = _position(F.col("n"), p)
        a, b = F.element_at("at", lo), F.element_at("at", hi)
        out.append((a + way * (b - a)).alias(f"{prefix}{i}"))
    return found.select(*keys, "column", "n", *out)


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float]) -> list[float | None]:
    """Exact quantiles of one column over all rows; null without values."""
    row = quantile_table(df, [], [col], probs).first()
    return [row[f"q{i}"] if row else None for i in range(len(probs))]


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    prefix: str = "q") -> DataFrame:
    """Exact quantiles per group: keys..., ``{prefix}0 … {prefix}{k-1}`` in the order of ``probs``."""
    return quantile_table(df, keys, [value], probs, prefix).drop("column", "n")


def quantiles_of_ranked(ranked: DataFrame, rank: str, value: str, n: int, probs: Sequence[float]) -> list[float | None]:
    """Exact quantiles of ``value`` when ``rank`` already orders it (0-based):
    only the neighbouring ranks of each position are read, no new sort."""
    if n == 0:
        return [None for _ in probs]
    want = {}
    for p in probs:
        h = (n - 1) * float(p)
        lo = int(h)
        want[p] = (lo, min(lo + 1, n - 1), h - lo)
    positions = sorted({i for lo, hi, _ in want.values() for i in (lo, hi)})
    vals = {r[0]: r[1] for r in ranked.filter(F.col(rank).isin(positions)).select(rank, F.col(value).cast("double")).collect()}
    return [vals[lo] + frac * (vals[hi] - vals[lo]) for lo, hi, frac in (want[p] for p in probs)]
