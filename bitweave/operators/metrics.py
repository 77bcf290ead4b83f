"""Evaluation: classes, bits, clusters, retrieval, elbows, and the choice of bits. All are aggregates; a score is one row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitweave.functions.bits import hamming, unpack


def class_accuracy(rows: DataFrame, n_classes: int) -> DataFrame:
    """(label, precision, recall, f1) from (predicted, expected); labels beyond n_classes are skipped, undefined is 0."""
    ok = rows.where(F.col("predicted").between(0, n_classes - 1) & F.col("expected").between(0, n_classes - 1))
    cells = ok.groupBy("predicted", "expected").agg(F.count(F.lit(1)).alias("n"))
    each = cells.select(F.explode(F.array(F.struct(F.col("predicted").alias("label"), F.when(F.col("predicted") == F.col("expected"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("p"), F.lit(0).cast("long").alias("e")), F.struct(F.col("expected").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("p"), F.col("n").alias("e")))).alias("x")).select("x.*")
    sums = each.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("p").alias("p"), F.sum("e").alias("e"))
    labels = rows.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("label"))
    s = labels.join(sums.withColumn("label", F.col("label").cast("int")), "label", "left").fillna(0)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    s = s.withColumn("precision", share(F.col("tp"), F.col("p"))).withColumn("recall", share(F.col("tp"), F.col("e")))
    return s.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("label", "precision", "recall", "f1")


def macro(per_class: DataFrame) -> DataFrame:
    return per_class.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))


def bit_errors(rows: DataFrame, n: int) -> DataFrame:
    """(bit, error) from (predicted, expected) codes."""
    z = F.arrays_zip(unpack(F.col("predicted"), n).alias("p"), unpack(F.col("expected"), n).alias("e"))
    return rows.select(F.posexplode(z).alias("bit", "x")).groupBy("bit").agg(F.avg((F.col("x.p") != F.col("x.e")).cast("double")).alias("error"))


def encoding_accuracy(rows: DataFrame, n: int) -> DataFrame:
    """mean_hamming = 1 - mean error, ber_min = 1 - least, ber_max = 1 - largest, ber_std over a sample."""
    e = bit_errors(rows, n)
    return e.agg((1 - F.avg("error")).alias("mean_hamming"), (1 - F.min("error")).alias("ber_min"), (1 - F.max("error")).alias("ber_max"), F.coalesce(F.stddev_samp("error"), F.lit(0.0)).alias("ber_std"))


def entropy_stats(codes: DataFrame, n: int) -> DataFrame:
    """mean, min, max and population deviation of the bits' entropies."""
    from bitweave.operators.selection import bit_entropy

    return bit_entropy(codes, unpack(F.col("code"), n)).agg(F.avg("entropy").alias("mean"), F.min("entropy").alias("min"), F.max("entropy").alias("max"), F.stddev_pop("entropy").alias("std"))


def clustering_accuracy(assignments: DataFrame, edges: DataFrame, metric: str = "min") -> DataFrame:
    """score: mean over nodes of the least (or mean) expected weight among neighbours of the same cluster."""
    a = assignments.where("cluster >= 0")
    e = edges.join(a.select(F.col("id").alias("src"), F.col("cluster").alias("ca")), "src").join(a.select(F.col("id").alias("dst"), F.col("cluster").alias("cb")), "dst").where("ca = cb")
    node = e.groupBy("src").agg((F.min if metric == "min" else F.avg)("weight").alias("s"))
    return node.agg(F.coalesce(F.avg("s"), F.lit(0.0)).alias("score"))


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson's, null where either side doesn't vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def retrieval_accuracy(edges: DataFrame, codes: DataFrame, margin: int, metric: str = "mean") -> DataFrame:
    """score: of each node, over expected neighbours within ``margin`` bits: mean or least weight, correlation of weight
    and nearness, or the share of the weights' variance; then the mean over nodes with any."""
    a, b = codes.select(F.col("id").alias("src"), F.col("code").alias("a")), codes.select(F.col("id").alias("dst"), F.col("code").alias("b"))
    d = edges.join(a, "src").join(b, "dst").withColumn("d", hamming(F.col("a"), F.col("b")))
    near = d.where(F.col("d") <= margin)
    if metric == "variance":
        all_ = d.groupBy("src").agg(F.var_pop("weight").alias("v"))
        node = near.groupBy("src").agg(F.var_pop("weight").alias("n")).join(all_, "src").select(F.when(F.col("v") > 0, 1 - F.col("n") / F.col("v")).otherwise(0.0).alias("s"))
    else:
        how = {"mean": F.avg("weight"), "min": F.min("weight"), "pearson": F.coalesce(correlation("weight", -F.col("d")), F.lit(0.0))}[metric]
        node = near.groupBy("src").agg(how.alias("s"))
    return node.agg(F.coalesce(F.avg("s"), F.lit(0.0)).alias("score"))


def _average_rank(column: Column, by: str) -> Column:
    """Ranks with ties averaged."""
    w = Window.partitionBy(by)
    return F.rank().over(w.orderBy(column)) + (F.count(F.lit(1)).over(Window.partitionBy(by, column)) - 1) / 2.0


def score_retrieval(retrieved: DataFrame, expected: DataFrame, n: int, ranking: str = "ndcg", query_ids: DataFrame | None = None) -> DataFrame:
    """(score, total_queries): of each query, its retrieved neighbours (src, dst, weight), by distance round((1 - w) * n),
    against expected weights; queries without a retrieved one count 0, those without an expected one are skipped.

    ndcg: linear gain, discount log2(rank + 1), order by (distance, dst). spearman: Pearson of average ranks. pearson.
    """
    exp = expected.select("src", "dst", F.col("weight").alias("rel"))
    if query_ids is not None:
        exp = exp.join(query_ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    queries = exp.select("src").distinct()
    got = retrieved.select("src", "dst", F.round((1 - F.col("weight")) * n).cast("long").alias("d")).join(queries, "src", "left_semi").join(exp, ["src", "dst"], "left").withColumn("rel", F.coalesce("rel", F.lit(0.0)))
    if ranking == "ndcg":
        w = Window.partitionBy("src").orderBy("d", "dst")
        ideal = exp.withColumn("i", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("rel"), "dst"))).groupBy("src").agg(F.sum(F.col("rel") / F.log2(F.col("i") + 1.0)).alias("idcg"))
        dcg = got.withColumn("i", F.row_number().over(w)).groupBy("src").agg(F.sum(F.col("rel") / F.log2(F.col("i") + 1.0)).alias("dcg"))
        s = ideal.join(dcg, "src", "left").select("src", F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0).alias("s"))
    else:
        x, y = (-F.col("d")).cast("double"), F.col("rel")
        if ranking == "spearman":
            got = got.withColumn("x", _average_rank(-F.col("d"), "src")).withColumn("y", _average_rank(F.col("rel"), "src"))
        else:
            got = got.withColumn("x", x).withColumn("y", y)
        corr = correlation("x", "y")
        s = queries.join(got.groupBy("src").agg(corr.alias("s")), "src", "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    return s.agg(F.coalesce(F.avg("s"), F.lit(0.0)).alias("score"), F.count(F.lit(1)).alias("total_queries"))


def elbow(values: np.ndarray, method: str = "max_gap", alpha: float = 1.0) -> int:
    """How many of the leading values of an ascending list lie before its elbow (at least 1 if there are any)."""
    n = len(values)
    if n < 3:
        return n
    v = np.asarray(values, float)
    gaps = np.diff(v)
    if method == "max_gap":
        return int(gaps.argmax()) + 1
    if method == "first_gap":
        big = np.flatnonzero(gaps > alpha * gaps.mean())
        return int(big[0]) + 1 if len(big) else n
    x = np.linspace(0, 1, n)
    y = (v - v[0]) / (v[-1] - v[0]) if v[-1] > v[0] else np.zeros(n)
    if method == "kneedle":
        return int((x - y).argmax()) + 1
    if method == "max_curvature":
        return int(np.abs(np.diff(y, 2)).argmax()) + 2
    if method == "plateau":
        flat = np.flatnonzero(np.diff(y) > alpha / n)
        return int(flat[0]) + 1 if len(flat) else n
    if method == "otsu":
        best = max(range(1, n), key=lambda c: c * (n - c) * (v[:c].mean() - v[c:].mean()) ** 2)
        return best
    if method == "lmethod":
        def loss(c: int) -> float:
            out = 0.0
            for a, b in ((0, c), (c, n)):
                if b - a > 1:
                    p = np.polyfit(x[a:b], v[a:b], 1)
                    out += float(((np.polyval(p, x[a:b]) - v[a:b]) ** 2).sum())
            return out

        return min(range(2, n - 1), key=loss) if n > 3 else 1
    raise ValueError(f"no elbow {method}")


def score_elbow(retrieved: DataFrame, expected: DataFrame, n: int, method: str = "max_gap", alpha: float = 1.0) -> DataFrame:
    """(quality, cutoff, total_queries): each ranked list cut at its elbow, F1 against the expected neighbours; means.

    A query's list is one row of numbers; its length is the neighbours asked for.
    """
    exp = expected.groupBy("src").agg(F.collect_set("dst").alias("want"))
    own = retrieved.select("src", F.struct(F.round((1 - F.col("weight")) * n).cast("double").alias("d"), "dst").alias("x")).groupBy("src").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    rows = exp.join(own, "src", "left").select("want", F.col("xs.d").alias("ds"), F.col("xs.dst").alias("ids"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for want, ds, ids in zip(pdf["want"], pdf["ds"], pdf["ids"]):
                c = elbow(np.asarray(ds), method, alpha) if ds is not None and len(ds) else 0
                hit = len(set(want) & set(ids[:c])) if c else 0
                out.append((2 * hit / (c + len(want)) if c + len(want) else 0.0, float(c)))
            yield pd.DataFrame(out, columns=["f1", "c"])

    return rows.mapInPandas(run, "f1 double, c double").agg(F.avg("f1").alias("quality"), F.avg("c").alias("cutoff"), F.count(F.lit(1)).alias("total_queries"))


def masked_score(edges: DataFrame, codes: DataFrame, n: int, masks: dict[str, list[int]], ranking: str = "spearman") -> dict[str, float]:
    """Score of each named choice of bits, all in one job: agreement of masked distances with expected weights."""
    a, b = codes.select(F.col("id").alias("src"), F.col("code").alias("a")), codes.select(F.col("id").alias("dst"), F.col("code").alias("b"))
    diff = F.zip_with(unpack(F.col("a"), n), unpack(F.col("b"), n), lambda x, y: (x != y).cast("int"))
    d = edges.join(a, "src").join(b, "dst").select("src", "dst", "weight", diff.alias("x"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("mask"), sum((F.element_at("x", i + 1) for i in bits[1:]), F.element_at("x", bits[0] + 1)).alias("d")) for k, bits in masks.items()]))
    long = d.select("src", "dst", "weight", each.alias("m")).select(F.concat_ws("|", F.col("m.mask"), F.col("src").cast("string")).alias("g"), "m.mask", "dst", "weight", "m.d")
    if ranking == "ndcg":
        i = F.row_number().over(Window.partitionBy("g").orderBy("d", "dst"))
        j = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("weight"), "dst"))
        node = long.withColumn("i", i).withColumn("j", j).groupBy("mask", "g").agg(F.sum(F.col("weight") / F.log2(F.col("i") + 1.0)).alias("p"), F.sum(F.col("weight") / F.log2(F.col("j") + 1.0)).alias("q")).select("mask", F.when(F.col("q") > 0, F.col("p") / F.col("q")).otherwise(0.0).alias("s"))
    else:
        r = long.withColumn("x", _average_rank(-F.col("d"), "g") if ranking == "spearman" else -F.col("d")).withColumn("y", _average_rank(F.col("weight"), "g") if ranking == "spearman" else F.col("weight"))
        node = r.groupBy("mask", "g").agg(F.coalesce(correlation("x", "y"), F.lit(0.0)).alias("s"))
    return {x["mask"]: x["s"] for x in node.groupBy("mask").agg(F.avg("s").alias("s")).collect()}


def optimize_bits(edges: DataFrame, codes: DataFrame, n: int, ranking: str = "spearman", keep_prefix: int = 0, start_prefix: int = 0, tolerance: float = 1e-12, each: Callable | None = None) -> tuple[list[int], float]:
    """(bits, score) by greedy search; every step scores all its candidates in one job.

    start_prefix below 0 tries all prefixes, 0 begins with the best single bit, above 0 with that prefix. Then, until
    neither helps: the first removal that gains more than the tolerance, else the first addition that loses none.
    """

    def score(sets: list[list[int]]) -> list[float]:
        got = masked_score(edges, codes, n, {str(i): s for i, s in enumerate(sets)}, ranking)
        return [got.get(str(i), 0.0) for i in range(len(sets))]

    if start_prefix > 0:
        now = list(range(start_prefix))
        best = score([now])[0]
    else:
        sets = [list(range(p)) for p in range(1, n + 1)] if start_prefix < 0 else [[i] for i in range(n)]
        s = score(sets)
        k = int(np.argmax(s))
        now, best = sets[k], s[k]
    while True:
        out = [[b for b in now if b != x] for x in now if x >= keep_prefix] if len(now) > 1 else []
        s = score(out) if out else []
        k = next((i for i, v in enumerate(s) if v > best + tolerance), None)
        if k is None:
            out = [sorted([*now, x]) for x in range(n) if x not in now]
            s = score(out) if out else []
            k = next((i for i, v in enumerate(s) if v > best + tolerance), None)
            if k is None:
                return now, best
        now, best = out[k], s[k]
        if each:
            each(now, best)
