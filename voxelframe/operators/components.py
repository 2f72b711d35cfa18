"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.tables import Tables


def _lowest(edges: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """edges (a, b) with the least b of each a as `low`, and the written table of minima.

    The minima are written first: the join then shuffles both sides by itself, so that adaptive execution can split
    a node with very many edges.
    """
    low = tables.cut(edges.groupBy("a").agg(F.min("b").alias("low")))
    return edges.join(low, "a"), low


def connected_components(edges: DataFrame, tables: Tables, rounds: int = 64) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is the least node it is connected with.

    Each round links every node's larger neighbours, then its smaller ones, to the least neighbour; the number of
    rounds grows with the logarithm of the diameter.  No task sees a whole component, nothing is collected.
    """
    a, b = F.col("a"), F.col("b")
    loops = edges.where(a == b).select(a.alias("node"), b.alias("root"))
    seen = Observation()  # the edges' number and sum are found as they are written
    marks = (F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
    now = tables.cut(edges.where(a != b).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().observe(seen, *marks))
    mark, found = None, seen.get
    for _ in range(rounds):
        if (found["n"], found["sum"]) == mark or not found["n"]:
            break
        mark = (found["n"], found["sum"])
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        far, low = _lowest(both, tables)
        large = tables.cut(far.where(b > a).select(b.alias("a"), F.least("a", "low").alias("b")).distinct())
        near, low_near = _lowest(large, tables)
        seen = Observation()
        new = tables.cut(near.select(b.alias("a"), F.col("low").alias("b")).where(a != b).unionByName(near.select("a", F.col("low").alias("b"))).distinct().observe(seen, *marks))
        found = seen.get
        for read in (now, low, large, low_near):  # the new edges are written: nothing reads these again
            tables.drop(read)
        now = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    named = now.select(a.alias("node"), b.alias("root")).unionByName(now.select(b.alias("node"), b.alias("root"))).unionByName(loops)
    return named.groupBy("node").agg(F.min("root").alias("root"))  # a loop's node may have other edges too
