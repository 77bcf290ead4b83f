"""Out-of-sample codes from neighbours: landmark and Nystrom encoders, authority scores, landmark choice, centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitweave.functions.bits import hamming, unpack


def landmark_encode(hoods: DataFrame, codes: DataFrame, n: int, mode: str = "frequency", n_thresholds: int = 1, quantile: bool = False, k: int = 24) -> DataFrame:
    """(id, bit, b) from (src, dst, dist, rank) to landmarks and their codes (id, code).

    concat: bits of the k neighbours one behind the other. frequency: bit t of b is 1 where the share of neighbours with b
    is above (t + 1) / (T + 1). weighted: the share weighed by similarity. quantile: thresholds are quantiles of the
    batch's own shares, at place floor(q * (n - 1)).
    """
    met = hoods.where(F.col("rank") <= k).join(codes.select(F.col("id").alias("dst"), "code"), "dst").select("src", "rank", (1.0 - F.col("dist")).alias("sim"), F.posexplode(unpack(F.col("code"), n)).alias("bit", "b"))
    if mode == "concat":
        return met.select(F.col("src").alias("id"), ((F.col("rank") - 1) * n + F.col("bit")).cast("int").alias("bit"), "b")
    w = F.col("sim") if mode == "weighted" else F.lit(1.0)
    share = met.groupBy("src", "bit").agg(F.sum(w * F.col("b")).alias("s"), F.sum(w).alias("t")).withColumn("p", F.when(F.col("t") > 0, F.col("s") / F.col("t")).otherwise(0.0))
    steps = F.explode(F.sequence(F.lit(0), F.lit(n_thresholds - 1)))
    if quantile:
        cuts = share.groupBy("bit").agg(F.percentile_approx("p", [(t + 1) / (n_thresholds + 1) for t in range(n_thresholds)], 100_000).alias("q"))
        share = share.join(F.broadcast(cuts), "bit").select("src", "bit", "p", F.posexplode("q").alias("t", "cut"))
    else:
        share = share.select("src", "bit", "p", steps.alias("t")).withColumn("cut", (F.col("t") + 1) / F.lit(float(n_thresholds + 1)))
    return share.select(F.col("src").alias("id"), (F.col("bit") * n_thresholds + F.col("t")).cast("int").alias("bit"), (F.col("p") > F.col("cut")).cast("int").alias("b"))


def nystrom_encode(hoods: DataFrame, vectors: DataFrame, values: list[float], k: int = 0) -> DataFrame:
    """(id, z): sums of similarity * eigenvector / eigenvalue over neighbours; values up to 1e-10 give 0."""
    near = hoods.where(F.col("rank") <= k) if k else hoods
    met = near.join(vectors.select(F.col("id").alias("dst"), "z"), "dst").withColumn("sim", 1.0 - F.col("dist"))
    sums = [F.sum(F.col("sim") * F.element_at("z", d + 1) / F.lit(v)) if v > 1e-10 else F.lit(0.0) for d, v in enumerate(values)]
    return met.groupBy(F.col("src").alias("id")).agg(F.array(*sums).alias("z"))


def authority_scores(ids: DataFrame, hoods: DataFrame, codes: DataFrame, n: int) -> DataFrame:
    """(id, score): mean share of differing bits to the neighbours by token; n where there is none. Lower is better."""
    a, b = codes.select(F.col("id").alias("src"), F.col("code").alias("a")), codes.select(F.col("id").alias("dst"), F.col("code").alias("b"))
    s = hoods.where("src <> dst").join(a, "src").join(b, "dst").groupBy(F.col("src").alias("id")).agg(F.avg(hamming(F.col("a"), F.col("b")) / F.lit(float(n))).alias("score"))
    return ids.select("id").join(s, "id", "left").withColumn("score", F.coalesce("score", F.lit(float(n))))


def select_landmarks(scores: DataFrame, assignments: DataFrame, k: int) -> DataFrame:
    """(id, cluster, score): the k best of each cluster; clusters below 0 are noise."""
    w = Window.partitionBy("cluster").orderBy("score", "id")
    return scores.join(assignments.where("cluster >= 0"), "id").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("id", "cluster", "score")


def centroids(codes: DataFrame, assignments: DataFrame, n: int) -> DataFrame:
    """(cluster, bit, votes, b): a bit of the centre is 1 where its votes, 1 or -1 a member, sum to 0 or more."""
    bits = codes.join(assignments, "id").select("cluster", F.posexplode(unpack(F.col("code"), n)).alias("bit", "b"))
    return bits.groupBy("cluster", "bit").agg(F.sum(F.col("b") * 2 - 1).alias("votes")).withColumn("b", (F.col("votes") >= 0).cast("int"))
