"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set holds the 64-bit hashes of its distinct 4-word shingles, its
sketch the K smallest of them.  Equal sets collapse to one row first, so copies
cost nothing later.  The retained values form inverted lists.  A link at
Jaccard 0.8 makes two sketches overlap in about 0.8 K values, and in fewer than
0.45 K with a probability of 2e-8, so two linked sketches share a value among
the rarest 0.55 K + 1 of each (prefix filter; values that occur once come first
and cost no row).  Candidates come in two steps:

1. star: each short list names one pseudo-random pivot, so a group of n near
   copies gives at most STAR * n pairs; the best pair of every row is verified
   and the verified links are contracted to components;
2. lists: pairs within a rare-value list whose rows lie in different components
   and have fitting sizes.  Rows of lists longer than LIST are joined to clusters
   and dealt out in blocks; the full sets of two blocks are compared by a matrix
   product, rows outside a cluster's largest component against all, and a block
   pair returns no more links than it joins components.

All other candidates pass the union-sketch estimate (EST, six standard deviations
below 0.8) and are then decided on their full sets.  Links inside a component
need no check, since they cannot change it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riselens.llm.common import clean_docs
from riselens.llm.components import connected_components, merge_components
from riselens.llm.textbuf import Words, batches, mix
from riselens.session import checkpoint

K = 48
STAR = 8
LIST = 8
BLOCK = 512
EST = 0.45
_MUL = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: list[str], width: int = 4):
    """For each text the sorted distinct 64-bit hashes of its word shingles (signed order)."""
    words = Words(texts, lower=True)
    h = words.hash
    rolled = h.copy()
    for k in range(1, width):
        rolled = rolled[: max(0, len(h) - k)] * _MUL + h[k:]
    rolled = mix(rolled).view(np.int64)
    for lo, hi in zip(words.bounds[:-1], words.bounds[1:]):
        n = hi - lo
        if n >= width:
            yield np.unique(rolled[lo : hi - width + 1])
        elif n:
            short = np.uint64(n)
            for x in h[lo:hi]:
                short = mix(np.array([short * _MUL + x], np.uint64))[0]
            yield np.array([short], np.uint64).view(np.int64)
        else:
            yield np.zeros(0, np.int64)


def _digest(s: np.ndarray) -> tuple[int, int]:
    u = s.view(np.uint64)
    return int(mix(u).sum(dtype=np.uint64).astype(np.int64)), int(mix(u ^ _MUL).sum(dtype=np.uint64).astype(np.int64))


def _sketch(width: int, k: int):
    def run(frames):
        for pdf in batches(frames):
            with np.errstate(over="ignore"):
                sets = list(shingle_sets(pdf["text"].tolist(), width))
                digests = [_digest(s) for s in sets]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n": [len(s) for s in sets], "d1": [d[0] for d in digests], "d2": [d[1] for d in digests], "sketch": [s[:k] for s in sets]})

    return run


def _full(width: int):
    def run(frames):
        for pdf in batches(frames):
            with np.errstate(over="ignore"):
                yield pd.DataFrame({"rep": pdf["doc_id"], "members": list(shingle_sets(pdf["text"].tolist(), width))})

    return run


def _estimate(pairs: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """Adds est, the Jaccard estimate of the union sketch, and keeps est >= EST."""
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), "a")
    both = both.join(sets.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b")
    both = both.withColumn("u", F.slice(F.sort_array(F.array_union("sa", "sb")), 1, k))
    est = F.size(F.array_intersect("u", F.array_intersect("sa", "sb"))) / F.size("u")
    return both.select("a", "b", est.alias("est")).where(F.col("est") >= EST)


def _verify(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    both = pairs.join(full.select(F.col("rep").alias("a"), F.col("members").alias("x")), "a")
    both = both.join(full.select(F.col("rep").alias("b"), F.col("members").alias("y")), "b")
    both = both.select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("i"))
    return both.where(100 * F.col("i") >= percent * (F.col("nx") + F.col("ny") - F.col("i"))).select("a", "b")


def _overlaps(a: list[np.ndarray], b: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets, by products over blocks of shared values."""
    shared = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)))
    out = np.zeros((len(a), len(b)), np.float32)

    def places(sets):
        value = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(shared, value), len(shared) - 1)
        hit = shared[at] == value
        order = np.argsort(at[hit], kind="stable")
        return row[hit][order], at[hit][order]

    if not len(shared):
        return out
    (ra, ca), (rb, cb) = places(a), places(b)
    for lo in range(0, len(shared), width):
        parts = []
        for n, r, c in ((len(a), ra, ca), (len(b), rb, cb)):
            s, e = np.searchsorted(c, [lo, lo + width])
            part = np.zeros((n, min(width, len(shared) - lo)), np.float32)
            part[r[s:e], c[s:e] - lo] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _tile(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between the components of two blocks of one cluster: one for each pair that the others leave apart."""
    a, b = left["members"].tolist(), right["members"].tolist()
    common = _overlaps(a, b)
    size = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :] - common
    ca, cb = left["comp"].to_numpy(), right["comp"].to_numpy()
    i, j = np.nonzero((100 * common >= percent * size) & (ca[:, None] != cb[None, :]))
    once = np.unique(np.stack((ca[i], cb[j])), axis=1, return_index=True)[1] if len(i) else []
    top: dict = {}

    def root(x):
        while x in top:
            x = top[x]
        return x

    links = []
    for k in once:
        x, y = root(int(ca[i[k]])), root(int(cb[j[k]]))
        if x != y:
            top[max(x, y)] = min(x, y)
            links.append((int(left["rep"].iat[i[k]]), int(right["rep"].iat[j[k]])))
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def _list_pairs(entries: DataFrame, full: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """Candidate pairs between components (a < b) of short lists, and verified links of the long ones."""
    per = entries.groupBy("h", "comp").agg(F.count("*").alias("c"), F.min("rep").alias("pivot"))
    lists = per.groupBy("h").agg(F.sum("c").alias("rows"), F.max("c").alias("most"), F.min("pivot").alias("pivot"))
    entries = checkpoint(entries.join(lists.where("rows > most"), "h"))
    x, y = (entries.where(F.col("rows") <= LIST).select("h", *(F.col(c).alias(c + s) for c in ("rep", "n", "comp"))) for s in "12")
    pairs = x.join(y, "h").where(f"rep1 < rep2 and comp1 <> comp2 and 100 * least(n1, n2) >= {percent} * greatest(n1, n2)")
    pairs = pairs.select(F.col("rep1").alias("a"), F.col("rep2").alias("b")).distinct()
    hot = entries.where(F.col("rows") > LIST)
    if hot.isEmpty():
        return pairs, None
    cluster = connected_components(hot.select(F.col("rep").alias("a"), F.col("pivot").alias("b")))
    rows = checkpoint(hot.select("rep", "comp").distinct().join(cluster.select(F.col("id").alias("rep"), F.col("component").alias("cluster")), "rep"))
    per = rows.groupBy("cluster", "comp").agg(F.count("*").alias("c"))
    sizes = per.groupBy("cluster").agg(F.sum("c").alias("all"), F.max(F.struct("c", "comp")).alias("main"))
    blocks = {"of_all": F.ceil(F.col("all") / BLOCK).cast("int"), "of_rest": F.ceil((F.col("all") - F.col("main.c")) / BLOCK).cast("int")}
    sizes = sizes.where(F.col("all") > F.col("main.c")).withColumns(blocks).select("cluster", "of_all", "of_rest", F.col("main.comp").alias("main"))
    rows = checkpoint(rows.join(sizes, "cluster").join(full, "rep"))
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where("comp <> main").select("cluster", "rep", "comp", "members", block("of_rest").alias("i"), every("of_all").alias("j"))
    right = rows.select("cluster", "rep", "comp", "members", every("of_rest").alias("i"), block("of_all").alias("j"))
    right = right.toDF(*(c + "_r" for c in right.columns))

    def compare(lt: pd.DataFrame, rt: pd.DataFrame) -> pd.DataFrame:
        if lt.empty or rt.empty:
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        return _tile(lt, rt.rename(columns=lambda c: c.removesuffix("_r")), percent)

    tiles = left.groupBy("cluster", "i", "j").cogroup(right.groupBy("cluster_r", "i_r", "j_r"))
    return pairs, checkpoint(tiles.applyInPandas(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``.

    Links hold where 100 * intersection >= percent * union of the word-shingle
    sets; component_id is the smallest doc_id reachable.  Null or wordless
    texts have no shingles and link with nothing.  A null doc_id links with
    nothing: its component_id is null and it is kept.  Rows that share a doc_id
    are one document, linked whatever their texts.  Repeated rows come back as
    often as they came; extra columns are ignored; an empty table stays empty.
    """
    src = clean_docs(docs)
    sk = checkpoint(src.mapInPandas(_sketch(width, k), "doc_id long, n long, d1 long, d2 long, sketch array<long>"))
    sets = sk.where("n > 0 and doc_id is not null").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"))
    sets = checkpoint(sets)
    v = sets.select("rep", F.posexplode("sketch").alias("pos", "h"))
    lists = v.groupBy("h").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("rep", "h").alias("x"), F.col("rep").alias("pivot"))).alias("p")).where("c > 1")
    shared = checkpoint(v.join(lists.select("h", "c", F.col("p.pivot").alias("pivot")), "h"))

    counted = shared.groupBy("rep").agg(F.count("*").alias("s"))
    size = F.least(F.col("n"), F.lit(k))
    able = sets.join(counted, "rep").select("rep", "n", "sketch", size.alias("m"), "s")
    able = able.where(F.col("s") >= F.ceil(EST * F.col("m")))
    able = checkpoint(able)
    full = checkpoint(src.join(able.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInPandas(_full(width), "rep long, members array<long>"))

    star = shared.where(f"pos < {STAR} and rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"), "rep").distinct()
    star = checkpoint(_estimate(star.select("a", "b").distinct(), able, k))
    ends = star.select(F.explode(F.array("a", "b")).alias("rep"), "a", "b", "est")
    best = ends.groupBy("rep").agg(F.max(F.struct("est", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
    edges = checkpoint(_verify(best, full, percent))
    comp = checkpoint(connected_components(edges))

    need = F.col("m") - F.ceil(EST * F.col("m")) + 1 - (F.col("m") - F.col("s"))
    entries = shared.join(able.select("rep", "n", need.alias("need")).where("need > 0"), "rep")
    entries = entries.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("c", "h"))).where("r <= need")
    entries = entries.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("h", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    more, links = _list_pairs(entries, full.dropDuplicates(["rep"]), percent)
    more = _estimate(more, able, k).select("a", "b")
    apart = star.select("a", "b").join(comp.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(comp.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
    apart = apart.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    late = _verify(more.union(apart).distinct(), full, percent)
    late = late if links is None else late.union(links)

    of_row = sk.join(sets.select("d1", "d2", "n", "rep"), ["d1", "d2", "n"], "left")
    of_row = of_row.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep"))
    again = sk.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1")
    twice = of_row.join(again, "doc_id", "left_semi").where("rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    comp = merge_components(comp, late.union(twice)).withColumnRenamed("id", "rep")
    out = of_row.join(comp, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
