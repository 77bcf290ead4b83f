"""Connected components of an edge table by alternating star contraction.

Each round links every node's larger neighbours to the smallest of its neighbourhood, then every node and its smaller
neighbours likewise, until nothing changes; the rounds grow with the logarithm of the longest path. All of it is
grouped minimums and equi-joins, so a hub of any degree is pre-aggregated before the shuffle and its join may be split
by adaptive execution. Each round is written to the shared folder, so the loss of an executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitweave.session import cut


def _star(sym: DataFrame) -> tuple[DataFrame, DataFrame]:
    low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return sym.join(low, "u"), low


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 50) -> DataFrame:
    """``(id, component)`` of every node of an edge; component is the smallest id reachable. Nodes without edges aren't listed.

    Raises if ``max_rounds`` don't suffice. Self-loops make their node a component of its own; edges with a null end are ignored; repeats do no harm.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(F.col(src).isNotNull() & F.col(dst).isNotNull()).distinct()
    e = cut(e)
    before = None
    for _ in range(max_rounds):
        both = e.where("u <> v").unionByName(e.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        joined, _low = _star(both)
        large = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        joined, low = _star(large)  # here u > v throughout: the smaller neighbours of u
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = cut(small.unionByName(e.where("u = v")).distinct())
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h"), F.sum((F.col("u") % 1000003) * 31 + F.col("v") % 1000003).alias("s")).first()
        e = now
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    nodes = e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    roots = e.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return nodes.unionByName(roots).groupBy("id").agg(F.min("component").alias("component"))
