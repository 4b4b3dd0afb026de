"""Connected components of an edge table, by DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riselens.session import checkpoint


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b); component: its smallest id.

    Alternating large-star and small-star steps: each step links every node to
    the smallest node it sees, so edges only shrink towards the minima and the
    number of rounds grows with the logarithm of the longest chain.  The
    neighbourhood minimum is a partial aggregate, so a hub of any degree is
    combined before the shuffle; the join back to the hub's edges is an inner
    join that adaptive execution splits.  Each round is a written table.  Once no
    node has two smaller neighbours the edges are a forest of pointers to smaller
    nodes, which halves its depth by pointer jumping, one join a step; the rounds
    end at depth one.
    Empty edges give an empty table at once; self-loops, repeated and null edges
    are ignored.
    """
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    e = checkpoint(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if e.isEmpty():
        return e.toDF("id", "component")
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s"))
        e = checkpoint(small.select("s.u", "s.v").where("u <> v").distinct())
        ends = e.select(F.col("u").alias("id"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(e.select(F.col("v"), F.lit(0), F.lit(1)))
        down = ends.groupBy("id").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1").agg(F.max("down")).first()[0]
        if down is None or down == 1:
            break
    else:
        raise RuntimeError("components did not settle")
    if down is not None:
        e = _jump(e)
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())


def _jump(e: DataFrame) -> DataFrame:
    """The forest ``e`` (u, v: its one smaller neighbour) with every v replaced by its root."""
    while True:
        above = e.select(F.col("u").alias("v"), F.col("v").alias("above"))
        step = checkpoint(e.select("u", "v").join(above, "v", "left").select("u", F.coalesce("above", "v").alias("v"), F.col("above").isNotNull().alias("moved")))
        if step.where("moved").isEmpty():
            return step.select("u", "v")
        e = step.select("u", "v")


def merge_components(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp`` (id, component) with the components that ``links`` (a, b) join made one.

    Only links between different components are followed, so the work grows with
    them and not with the edges that made ``comp``; ids new to it are added.  Null
    links are ignored; without links between components ``comp`` comes back.
    """
    ends = links.where("a is not null and b is not null").select("a", "b")
    for side in "ab":
        of = comp.select(F.col("id").alias(side), F.col("component").alias("c" + side))
        ends = ends.join(of, side, "left").withColumn("c" + side, F.coalesce("c" + side, side))
    joined = connected_components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    known = comp.join(joined.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left")
    known = known.select("id", F.coalesce("to", "component").alias("component"))
    return known.union(joined.join(comp, "id", "left_anti").select("id", "component"))
