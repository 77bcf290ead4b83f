"""Graph construction: typed edge sources, neighbour edges, local scaling, bridging, weights, adjacency.

Edges are (src, dst, ...) with src < dst unless said otherwise. Every stage is a DataFrame; bridging contracts components
round by round (each takes its nearest crossing edge), so the rounds grow with the logarithm of their number.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitweave.operators.components import connected_components
from bitweave.operators.setjoin import hash_number
from bitweave.session import stage


def undirected(edges: DataFrame, *keep: str) -> DataFrame:
    """(src, dst) with src < dst, once each; of kept columns the first by order."""
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *keep)
    return e.groupBy("src", "dst").agg(*[F.min(k).alias(k) for k in keep]) if keep else e.distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, other columns kept."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *rest).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def bipartite_edges(bits: DataFrame, first_feature_node: int) -> DataFrame:
    """Edges from rows to the nodes of their features, numbered from ``first_feature_node``."""
    return undirected(bits.select(F.col("id").alias("src"), (F.col("feature") + first_feature_node).alias("dst")))


def seed_edges(csr: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges of an adjacency in rows: ``csr`` (row, neighbors array of rows), ``ids`` (row, id)."""
    e = csr.select("row", F.explode("neighbors").alias("n"))
    a, b = ids.select("row", F.col("id").alias("src")), ids.select(F.col("row").alias("n"), F.col("id").alias("dst"))
    return undirected(e.join(a, "row").join(b, "n").select("src", "dst"))


def anchor_edges(categories: DataFrame, anchors: int, k: int, decay: float = 0.0, seed: str = "anchors") -> DataFrame:
    """Edges of members to anchors of their category: (id, category[, rank]); anchors are the first in keyed order.

    A member takes ceil(k * exp(-rank * |decay|)) of them, nearest first in the keyed order of the pair.
    """
    c = categories.select("id", "category", F.col("rank") if "rank" in categories.columns else F.lit(0).alias("rank"))
    w = Window.partitionBy("category").orderBy(hash_number(F.lit(seed), F.col("category").cast("string"), F.col("id").cast("string")), "id")
    heads = c.withColumn("r", F.row_number().over(w)).where(F.col("r") <= anchors).select("category", F.col("id").alias("a"), "r")
    met = c.join(heads, "category").where("id <> a")
    pick = Window.partitionBy("id", "category").orderBy(hash_number(F.lit(seed), F.col("id").cast("string"), F.col("a").cast("string")), "a")
    wanted = F.ceil((k or anchors) * F.exp(-F.col("rank") * abs(decay)))
    return undirected(met.withColumn("p", F.row_number().over(pick)).where(F.col("p") <= wanted).select(F.col("id").alias("src"), F.col("a").alias("dst")))


def knn_edges(hoods: DataFrame, k: int, eps: float = 1.0) -> DataFrame:
    """Edges to each row's k nearest within eps: (src, dst, dist), the union of both directions."""
    return undirected(hoods.where((F.col("rank") <= k) & (F.col("dist") <= eps)), "dist")


def intrinsic_dimension(hoods: DataFrame) -> float:
    """Levina-Bickel estimate: 1 over the mean of each row's mean ln(R / d); within [1, 100], 2 where undefined."""
    far = Window.partitionBy("src")
    d = hoods.where("dist > 0").withColumn("R", F.max("dist").over(far)).where("dist < R").groupBy("src").agg(F.avg(F.log(F.col("R") / F.col("dist"))).alias("m"))
    got = d.agg(F.avg("m").alias("m")).first().m
    return min(100.0, max(1.0, 1.0 / got)) if got and got > 0 else 2.0


def cknn_edges(edges: DataFrame, hoods: DataFrame, k: int, alpha: float = 1.0) -> DataFrame:
    """Edges with dist <= delta * sqrt(rho_src * rho_dst); rho is the distance to the k-th neighbour (or the last)."""
    near = symmetric(edges.select("src", "dst", "dist")).unionByName(hoods.select("src", "dst", "dist")).groupBy("src", "dst").agg(F.min("dist").alias("dist"))
    rho = near.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))).where(F.col("r") <= k).groupBy("src").agg(F.max("dist").alias("rho"))
    n = rho.count()
    delta = min(10.0, max(1e-3, alpha * max(n, 1) ** (-2.0 / (intrinsic_dimension(hoods) + 6.0))))
    e = edges.join(rho, "src").withColumnRenamed("rho", "ra").join(rho.withColumnRenamed("src", "dst").withColumnRenamed("rho", "rb"), "dst")
    return e.where(F.col("dist") <= delta * F.sqrt(F.col("ra") * F.col("rb"))).select("src", "dst", "dist")


def resolve_distances(edges: DataFrame, *sources: DataFrame) -> DataFrame:
    """Adds ``dist`` from the first source (src, dst, dist) that has the pair; 1 where none does."""
    out, names = edges.select("src", "dst"), []
    for i, s in enumerate(sources):
        names.append(f"_d{i}")
        out = out.join(s.select("src", "dst", F.col("dist").alias(names[-1])), ["src", "dst"], "left")
    return out.select("src", "dst", F.least(F.lit(1.0), F.coalesce(*names, F.lit(1.0))).alias("dist"))


def pooled(directed: DataFrame, pooling: str = "min") -> DataFrame:
    """One distance an edge from both directions: "min" takes the smaller similarity, so the larger distance."""
    e = directed.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "dist")
    return e.groupBy("src", "dst").agg((F.max if pooling == "min" else F.min)("dist").alias("dist"))


def weights(edges: DataFrame, mode: str = "linear", k: int = 0, alpha: float = 1.0, eps: float = 1e-8) -> DataFrame:
    """Adds ``weight``: 1 - dist, or exp(-d^2 / (2 s_src s_dst)) with s = alpha * the k-th smallest distance of a row."""
    d = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("dist")))
    if mode != "sigma":
        return edges.withColumn("weight", F.least(F.lit(1.0), F.greatest(F.lit(eps), 1.0 - d)))
    both = symmetric(edges.select("src", "dst", "dist"))
    s = both.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))).where(F.col("r") <= max(k, 1)).groupBy("src").agg((F.max("dist") * alpha).alias("s"))
    e = edges.join(s, "src").withColumnRenamed("s", "sa").join(s.withColumnRenamed("src", "dst").withColumnRenamed("s", "sb"), "dst")
    raw = F.when(F.col("sa") * F.col("sb") > 0, F.exp(-d * d / (2 * F.col("sa") * F.col("sb")))).otherwise(F.when(d > 0, 0.0).otherwise(1.0))
    return e.withColumn("weight", F.least(F.lit(1.0), F.greatest(F.lit(eps), raw))).select("src", "dst", "dist", "weight")


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component) of all nodes; those without edges are their own."""
    c = connected_components(edges)
    if nodes is None:
        return c
    return nodes.select("id").distinct().join(c, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def spanning_forest(candidates: DataFrame, nodes: DataFrame | None = None, max_rounds: int = 60) -> DataFrame:
    """(src, dst, dist): edges of a minimum spanning forest of the candidates, by rounds of each component's nearest
    crossing edge; ties by (dist, src, dst), which makes the forest unique."""
    cand = stage(undirected(candidates, "dist"), "candidates")
    comp = nodes.select("id", "component") if nodes is not None else cand.select(F.col("src").alias("id")).unionByName(cand.select(F.col("dst").alias("id"))).distinct().withColumn("component", F.col("id"))
    comp, chosen = stage(comp, "components"), []
    for _ in range(max_rounds):
        a, b = comp.select(F.col("id").alias("src"), F.col("component").alias("ca")), comp.select(F.col("id").alias("dst"), F.col("component").alias("cb"))
        cross = cand.join(a, "src").join(b, "dst").where("ca <> cb")
        sides = cross.select("ca", "dist", "src", "dst", "cb").unionByName(cross.select(F.col("cb").alias("ca"), "dist", "src", "dst", F.col("ca").alias("cb")))
        low = stage(sides.groupBy("ca").agg(F.min(F.struct("dist", "src", "dst", "cb")).alias("m")).select("m.*", "ca"), "crossing")
        if low.isEmpty():
            break
        chosen.append(low.select("src", "dst", "dist").distinct())
        merged = _contract(low.select(F.col("ca").alias("src"), F.col("cb").alias("dst")))
        comp = stage(comp.join(merged.select(F.col("id").alias("component"), F.col("component").alias("c2")), "component", "left").select("id", F.coalesce("c2", "component").alias("component")), "components")
    else:
        raise RuntimeError(f"the forest is not settled after {max_rounds} rounds")
    out = cand.limit(0).select("src", "dst", "dist")
    for c in chosen:
        out = out.unionByName(c)
    return out


LOCAL_EDGES = 100_000


def _contract(links: DataFrame) -> DataFrame:
    """Components of the links; a few are united on the driver, more than LOCAL_EDGES by the cluster. Same result."""
    if links.count() > LOCAL_EDGES:  # a limit would bring as many rows of each of several tasks
        return connected_components(links)
    some = links.collect()
    root: dict[int, int] = {}

    def find(x: int) -> int:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in some:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return links.sparkSession.createDataFrame([(x, find(x)) for x in list(root)], "id long, component long")


def bridge_mst(edges: DataFrame, candidates: DataFrame, nodes: DataFrame | None = None, seed: str = "ring") -> DataFrame:
    """Edges with those added that join components: first the nearest candidates, then a ring through the busiest nodes."""
    comp = components(edges, nodes)
    extra = stage(spanning_forest(candidates, comp), "bridges")
    joined = edges.select("src", "dst", "dist").unionByName(extra)
    comp = stage(components(joined, comp.select("id")), "components")
    degree = symmetric(joined.select("src", "dst")).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
    reps = comp.join(degree, "id", "left").groupBy("component").agg(F.max(F.struct(F.coalesce("deg", F.lit(0)).alias("deg"), (-F.col("id")).alias("m"))).alias("x")).select((-F.col("x.m")).alias("id"))
    order = Window.orderBy(hash_number(F.lit(seed), F.col("id").cast("string")), "id")  # one row a component
    ring = reps.withColumn("next", F.lead("id").over(order)).where("next is not null").select(F.col("id").alias("src"), F.col("next").alias("dst"), F.lit(1.0).alias("dist"))
    return undirected(joined.unionByName(ring), "dist")


def largest(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Edges of the largest component; of equally large ones the one of the smallest id."""
    comp = stage(components(edges, nodes), "components")
    top = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", (-F.col("component")).alias("m"))).alias("x")).first().x
    if top is None:
        return edges
    own = comp.where(F.col("component") == -top["m"]).select(F.col("id").alias("src"))
    return edges.join(own, "src", "left_semi")


def adjacency_rows(edges: DataFrame) -> DataFrame:
    """(id, neighbors, weights), heaviest first, from edges with weight."""
    rows = symmetric(edges.select("src", "dst", "weight")).groupBy("src").agg(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "dst"))).alias("n"))
    return rows.select(F.col("src").alias("id"), F.col("n.dst").alias("neighbors"), F.transform("n.w", lambda w: -w).alias("weights"))


@dataclass(frozen=True)
class Adjacency:
    """Settings of :func:`adjacency`, the whole chain."""

    knn: int = 0
    knn_eps: float = 1.0
    knn_mode: str = "plain"
    knn_alpha: float = 1.0
    knn_mutual: bool = False
    random_pairs: int = 0
    category_anchors: int = 0
    category_knn: int = 0
    category_decay: float = 0.0
    bridge: str = "mst"
    weight_eps: float = 1e-8


def adjacency(nodes: DataFrame, s: Adjacency, hoods: DataFrame | None = None, seeds: DataFrame | None = None, categories: DataFrame | None = None, distances: Callable[[DataFrame], DataFrame] | None = None, each: Callable | None = None) -> DataFrame:
    """Edges (src, dst, dist, weight) over ``nodes`` from seeds, anchors, random pairs and neighbours, bridged and weighed.

    ``distances`` gives (src, dst, dist) for pairs; edges from neighbours bring theirs. ``each(stage, edges)`` sees every
    stage.
    """
    from bitweave.operators.pairs import random_pairs
    from bitweave.operators.setjoin import mutualize

    def told(name: str, e: DataFrame) -> DataFrame:
        if each:
            each(name, e)
        return e

    near = hoods
    if near is not None and s.knn_mutual:
        near = mutualize(near)
    parts = []
    if seeds is not None:
        parts.append(told("seed", undirected(seeds).withColumn("dist", F.lit(None).cast("double"))))
    if categories is not None and s.category_anchors:
        parts.append(told("anchors", anchor_edges(categories, s.category_anchors, s.category_knn, s.category_decay).withColumn("dist", F.lit(None).cast("double"))))
    if s.random_pairs:
        parts.append(told("random", random_pairs(nodes, s.random_pairs).withColumn("dist", F.lit(None).cast("double"))))
    if near is not None and s.knn:
        parts.append(told("knn", knn_edges(near, s.knn, s.knn_eps)))
    e = parts[0]
    for p in parts[1:]:
        e = e.unionByName(p)
    e = undirected(e, "dist")
    known = [e.where("dist is not null")] + ([undirected(hoods, "dist")] if hoods is not None else [])
    e = stage(resolve_distances(e, *([distances(e.select("src", "dst"))] if distances else []), *known), "edges")
    if s.knn_mode == "cknn" and hoods is not None:
        e = stage(cknn_edges(e, hoods, s.knn, s.knn_alpha), "edges")
    if s.bridge == "mst":
        e = bridge_mst(e, hoods if hoods is not None else e, nodes)
    elif s.bridge == "largest":
        e = largest(e, nodes)
    return told("bridge", weights(e, s.knn_mode, s.knn, s.knn_alpha, s.weight_eps))


def pair_adjacency(ids: DataFrame, positive: DataFrame, negative: DataFrame) -> DataFrame:
    """Both directions of listed pairs, weight 1 for positive and 0 for negative ones; unknown ids go, repeats stay."""
    own = ids.select("id").distinct()
    e = positive.select("src", "dst", F.lit(1.0).alias("weight")).unionByName(negative.select("src", "dst", F.lit(0.0).alias("weight")))
    e = e.join(own.withColumnRenamed("id", "src"), "src", "left_semi").join(own.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return symmetric(e.select("src", "dst", "weight"))


def hood_adjacency(hoods: DataFrame, n_features: int) -> DataFrame:
    """Neighbourhoods by distance in bits as (src, dst, weight = 1 - dist / n_features)."""
    if n_features <= 0:
        raise ValueError("n_features must be above 0")
    return hoods.select("src", "dst", (1.0 - F.col("dist") / float(n_features)).alias("weight"))


def edge_weight(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The weight of each pair, 0 where there is no edge."""
    w = symmetric(edges.select("src", "dst", "weight"))
    return pairs.select("src", "dst").join(w, ["src", "dst"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def manifold_delta(n: int, dimension: float, alpha: float = 1.0) -> float:
    """The factor of :func:`cknn_edges` for n rows of that dimension."""
    return min(10.0, max(1e-3, alpha * math.pow(max(n, 1), -2.0 / (dimension + 6.0))))
