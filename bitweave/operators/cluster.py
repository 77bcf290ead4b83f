"""Graph-constrained agglomerative clustering of binary codes with complete linkage, and cuts of its dendrogram.

Rows with equal codes begin as one cluster. Clusters joined by an edge merge in order of their complete-linkage distance
(the largest Hamming distance between members' codes); the smaller is absorbed, ties by id. Components of the graph never
merge with each other, so each is a group of its own; a component above ``max_codes`` distinct codes is refused, as its
merges are one sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitweave.operators.components import connected_components
from bitweave.session import stage


def _merge(max_codes: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pdf[pdf["dst"].isna()].sort_values("src")
        ids, n = nodes["src"].to_numpy(np.int64), len(nodes)
        if n > max_codes:
            raise ValueError(f"a component has {n} distinct codes, above max_codes = {max_codes}")
        at = {v: i for i, v in enumerate(ids)}
        codes = np.array(nodes["code"].tolist(), np.uint64)
        x = np.bitwise_count(codes[:, None, :] ^ codes[None, :, :]).sum(2).astype(np.int32)  # complete linkage, kept up to date
        size = nodes["size"].to_numpy(np.int64).copy()
        near = {i: set() for i in range(n)}
        for a, b in pdf.loc[pdf["dst"].notna(), ["src", "dst"]].astype("int64").itertuples(index=False):
            near[at[a]].add(at[b])
            near[at[b]].add(at[a])
        rows, seq, live = [], 0, set(range(n))
        while True:
            d, a, b = min(((int(x[i, j]), i, j) for i in live for j in near[i] if i < j), default=(None, 0, 0))
            if d is None:
                break
            if size[b] > size[a]:
                a, b = b, a
            rows.append((int(d), seq, int(ids[b]), int(ids[a])))
            seq += 1
            size[a] += size[b]
            x[a] = np.maximum(x[a], x[b])
            x[:, a] = x[a]
            live.discard(b)
            for j in near.pop(b):
                near[j].discard(b)
                if j != a:
                    near[a].add(j)
                    near[j].add(a)
            near[a].discard(b)
        return pd.DataFrame(rows, columns=["dist", "seq", "absorbed", "surviving"]).assign(component=int(pdf["component"].iloc[0]))

    return run


def cluster(codes: DataFrame, edges: DataFrame, max_codes: int = 4_000) -> tuple[DataFrame, DataFrame]:
    """(initial, merges): initial (id, cluster), the smallest id of its code; merges (dist, seq, absorbed, surviving, component)."""
    heads = codes.groupBy("code").agg(F.min("id").alias("cluster"), F.count(F.lit(1)).alias("size"))
    initial = stage(codes.join(heads, "code").select("id", "cluster", "code", "size"), "initial")
    a, b = initial.select(F.col("id").alias("src"), F.col("cluster").alias("a")), initial.select(F.col("id").alias("dst"), F.col("cluster").alias("b"))
    e = stage(edges.join(a, "src").join(b, "dst").where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "edges")
    comp = connected_components(e)
    nodes = initial.select(F.col("cluster").alias("id"), "code", "size").distinct().join(comp, "id")
    rows = nodes.select("component", F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), "code", "size").unionByName(
        e.join(comp.withColumnRenamed("id", "src"), "src").select("component", "src", "dst", F.lit(None).cast("array<long>").alias("code"), F.lit(None).cast("long").alias("size"))
    )
    merges = rows.groupBy("component").applyInPandas(_merge(max_codes), "dist long, seq long, absorbed long, surviving long, component long")
    return initial.select("id", "cluster"), stage(merges, "merges")


def cut(initial: DataFrame, merges: DataFrame, below: int) -> DataFrame:
    """(id, cluster) after all merges of a distance under ``below``; clusters are numbered by their smallest id."""
    links = merges.where(F.col("dist") < below).select(F.col("absorbed").alias("src"), F.col("surviving").alias("dst"))
    comp = connected_components(links).withColumnRenamed("id", "cluster").withColumnRenamed("component", "root")
    got = initial.join(comp, "cluster", "left").select("id", F.coalesce("root", "cluster").alias("root"))
    first = got.groupBy("root").agg(F.min("id").alias("cluster"))
    return got.join(first, "root").select("id", "cluster")


def members(assignments: DataFrame) -> DataFrame:
    """(cluster, ids, size) of a cut."""
    return assignments.groupBy("cluster").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.count(F.lit(1)).alias("size"))


def cuts(initial: DataFrame, merges: DataFrame) -> Iterator[tuple[int, DataFrame]]:
    """(distance, assignments) of the cut after each distance at which anything merges."""
    yield 0, cut(initial, merges, 0)
    for r in merges.select("dist").distinct().orderBy("dist").collect():
        yield r["dist"] + 1, cut(initial, merges, r["dist"] + 1)


def quality(assignments: DataFrame, codes: DataFrame, n: int) -> DataFrame:
    """(quality): mean similarity of members to the centre of their cluster."""
    from bitweave.functions.bits import unpack
    from bitweave.operators.landmarks import centroids

    c = centroids(codes, assignments, n).select("cluster", "bit", F.col("b").alias("c"))
    bits = codes.join(assignments, "id").select("id", "cluster", F.posexplode(unpack(F.col("code"), n)).alias("bit", "b"))
    return bits.join(c, ["cluster", "bit"]).agg(F.avg((F.col("b") == F.col("c")).cast("double")).alias("quality"))
