"""Dense embeddings to binary codes: by sign, median, Otsu split, or a learned rotation.

Fitted state is one value a dimension (or a small matrix); scoring is a projection. Null or short vectors keep null codes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitweave.functions.bits import pack


def _dims(rows: DataFrame, vec: str) -> DataFrame:
    return rows.select(F.posexplode(vec).alias("dim", "v")).select("dim", F.col("v").cast("double").alias("v"))


def at_least(vec: Column, thresholds: list[float]) -> Column:
    """array<int>: 1 where a component is at least its threshold."""
    t = F.array(*[F.lit(float(x)) for x in thresholds])
    return F.zip_with(vec.cast("array<double>"), t, lambda a, b: (a >= b).cast("int"))


def sign(rows: DataFrame, n: int, vec: str = "embedding") -> DataFrame:
    """Adds ``code``: a bit is 1 where the component is at least 0."""
    return rows.withColumn("code", pack(F.transform(vec, lambda x: (x >= 0).cast("int")), n))


def median_thresholds(rows: DataFrame, vec: str = "embedding") -> DataFrame:
    """(dim, threshold): the median; the mean of the middle two for an even count. Counts are merged before the shuffle."""
    return _dims(rows, vec).groupBy("dim").agg(F.percentile("v", 0.5).alias("threshold"))


def otsu_thresholds(rows: DataFrame, vec: str = "embedding", metric: str = "variance", n_bins: int = 32, minimize: bool = False) -> DataFrame:
    """(dim, threshold, score, place): the best split of a histogram, dimensions placed by score.

    metric: between-class variance of bin centres, or the summed entropies of both sides. A dimension without range
    scores 0 at its least value.
    """
    n_bins = n_bins or 32
    d = _dims(rows, vec)
    span = d.groupBy("dim").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    flat = span.where("hi - lo < 1e-10").select("dim", F.col("lo").alias("threshold"), F.lit(0.0).alias("score"))
    wide = span.where("hi - lo >= 1e-10")
    binned = d.join(F.broadcast(wide), "dim").withColumn("bin", F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (n_bins - 1)))
    h = binned.groupBy("dim", "bin").agg(F.count(F.lit(1)).cast("double").alias("c"))
    grid = wide.select("dim", "lo", "hi", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bins - 1).cast("long"))).alias("bin"))
    h = grid.join(h, ["dim", "bin"], "left").withColumn("c", F.coalesce("c", F.lit(0.0)))
    h = h.withColumn("centre", F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("bin") + 0.5) / n_bins)
    up = Window.partitionBy("dim").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy("dim")
    h = h.withColumn("n", F.sum("c").over(all_)).withColumn("c0", F.sum("c").over(up)).withColumn("m0", F.sum(F.col("c") * F.col("centre")).over(up)).withColumn("mt", F.sum(F.col("c") * F.col("centre")).over(all_))
    c1 = F.col("n") - F.col("c0")
    if metric == "variance":
        gap = F.col("m0") / F.col("c0") - (F.col("mt") - F.col("m0")) / c1
        score = F.when((F.col("c0") > 0) & (c1 > 0), F.col("c0") / F.col("n") * (c1 / F.col("n")) * gap * gap)
    else:
        h = h.withColumn("cl", F.when(F.col("c") > 0, F.col("c") * F.log("c")).otherwise(0.0))
        h = h.withColumn("l0", F.sum("cl").over(up)).withColumn("lt", F.sum("cl").over(all_))
        part = lambda c, s: F.log(c) - s / c  # noqa: E731  entropy of the side's own distribution
        score = F.when((F.col("c0") > 0) & (c1 > 0), part(F.col("c0"), F.col("l0")) + part(c1, F.col("lt") - F.col("l0")))
    h = h.withColumn("score", score).where(f"score is not null and bin < {n_bins - 1}")
    best = h.groupBy("dim", "lo", "hi").agg(F.max(F.struct("score", (-F.col("bin")).alias("b"))).alias("m"))
    found = best.select("dim", (F.col("lo") + (F.col("hi") - F.col("lo")) * (1 - F.col("m.b")) / n_bins).alias("threshold"), F.col("m.score").alias("score"))
    order = Window.orderBy(F.col("score").asc() if minimize else F.col("score").desc(), "dim")
    return found.unionByName(flat).withColumn("place", F.row_number().over(order) - 1)


def apply_thresholds(rows: DataFrame, fitted: DataFrame, n: int, vec: str = "embedding") -> DataFrame:
    """Adds ``code`` by fitted thresholds, in order of ``place`` where there is one; ``fitted`` has a row a dimension."""
    place = "place" if "place" in fitted.columns else "dim"
    got = [(r[place], r["dim"], r["threshold"]) for r in fitted.select(F.col(place), "dim", "threshold").collect()] if place != "dim" else [(r["dim"], r["dim"], r["threshold"]) for r in fitted.select("dim", "threshold").collect()]
    got.sort()
    picked = F.array(*[F.element_at(F.col(vec).cast("array<double>"), d + 1) for _, d, _ in got])
    return rows.withColumn("code", F.when(F.col(vec).isNotNull(), pack(at_least(picked, [t for _, _, t in got]), n)))


def _gram(vec: str, mean: np.ndarray, rotation: np.ndarray):
    """Partial sums of sign(XR)'X and of the loss, one row a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(mean)
        total, loss = np.zeros((k, k)), 0.0
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[vec].to_numpy()).astype(float) - mean
                v = x @ rotation
                b = np.where(v >= 0, 1.0, -1.0)
                total += b.T @ x
                loss += float(((b - v) ** 2).sum())
        yield pd.DataFrame({"g": [total.ravel()], "loss": [loss]})

    return run


def itq_fit(rows: DataFrame, vec: str = "embedding", iterations: int = 1000, tolerance: float = 1e-8, each: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(mean, rotation) of iterative quantisation: turn the centred data so that its signs lose least.

    Only dims x dims sums leave a task. Starts from the identity; stops where the loss settles.
    """
    rows = rows.where(F.col(vec).isNotNull()).select(vec)
    mean = np.array([r["m"] for r in _dims(rows, vec).groupBy("dim").agg(F.avg("v").alias("m")).orderBy("dim").collect()])
    k = len(mean)
    rotation, before = np.eye(k), None
    for i in range(iterations):
        parts = rows.mapInPandas(_gram(vec, mean, rotation), "g array<double>, loss double")
        sums = parts.select(F.posexplode("g").alias("p", "v"), "loss").groupBy("p").agg(F.sum("v").alias("v"), F.sum("loss").alias("loss")).orderBy("p").collect()
        gram, loss = np.array([r["v"] for r in sums]).reshape(k, k), sums[0]["loss"]
        if each and each(i, loss) is False:
            break
        if before is not None and abs(before - loss) < tolerance * abs(loss):
            break
        before = loss
        u, _, vt = np.linalg.svd(gram)
        rotation = vt.T @ u.T
    return mean, rotation


def itq_encode(rows: DataFrame, mean: np.ndarray, rotation: np.ndarray, id: str, vec: str = "embedding") -> DataFrame:
    """(id, code) by the sign of the centred, turned vectors."""
    k = len(mean)
    kind = dict(rows.dtypes)[id]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                b = (np.stack(pdf[vec].to_numpy()).astype(float) - mean) @ rotation >= 0
                yield pd.DataFrame({id: pdf[id], "bits": list(b.astype("int32"))})

    return rows.where(F.col(vec).isNotNull()).select(id, vec).mapInPandas(run, f"{id} {kind}, bits array<int>").select(id, pack(F.col("bits"), k).alias("code"))
