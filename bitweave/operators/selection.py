"""Feature statistics and selection over long-form bits (id, feature) and labels (id, label).

Counts are partially aggregated; the contingency of each feature and class is four sums. idf is ln(n / df).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def document_frequency(bits: DataFrame, n: int | None = None, min_df: int = 1, max_df: float = 1.0, k: int | None = None) -> DataFrame:
    """(feature, df, idf), most frequent first, at most k; max_df as a share of n rows."""
    n = bits.select("id").distinct().count() if n is None else n
    df = bits.distinct().groupBy("feature").agg(F.count(F.lit(1)).alias("df")).withColumn("n", F.lit(n))
    df = df.where((F.col("df") >= min_df) & (F.col("df") <= F.col("n") * max_df)).withColumn("idf", F.log(F.col("n") / F.col("df"))).drop("n")
    if k is None:
        return df
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("df"), "feature")) - 1).where(F.col("rank") < k)


def contingency(bits: DataFrame, labels: DataFrame) -> DataFrame:
    """(feature, label, n11, n1x, nx1, n): rows with both, with the feature, with the label, all. Labels are few.

    ``bits`` are (id, feature), or sets (id, features) of distinct features, one row an id, which are labelled before they
    are taken apart. One row of counts a feature is shuffled.
    """
    lab = labels.select("id", "label").where("label is not null")
    per_label = lab.groupBy("label").count().orderBy("label").collect()
    n = sum(r["count"] for r in per_label)
    kind = dict(lab.dtypes)["label"]
    if not per_label:
        return bits.sparkSession.createDataFrame([], f"feature {_feature_kind(bits)}, label {kind}, n11 bigint, n1x bigint, nx1 bigint, n bigint")
    if "features" in bits.columns:
        own = bits.join(lab, "id").select(F.explode("features").alias("feature"), "label")
    else:
        own = bits.join(lab.select("id").distinct(), "id", "left_semi").distinct().join(lab, "id")
    count = lambda v: F.count(F.when(F.col("label") == F.lit(v).cast(kind), 1))
    wide = own.where("feature is not null").groupBy("feature").agg(*[count(r["label"]).alias(f"n{i}") for i, r in enumerate(per_label)])
    n1x = sum((F.col(f"n{i}") for i in range(1, len(per_label))), F.col("n0"))
    each = F.array(*[F.struct(F.lit(r["label"]).cast(kind).alias("label"), F.col(f"n{i}").alias("n11"), F.lit(r["count"]).alias("nx1")) for i, r in enumerate(per_label)])
    return wide.select("feature", n1x.alias("n1x"), F.explode(each).alias("_e")).select("feature", "_e.label", "_e.n11", "n1x", "_e.nx1", F.lit(n).alias("n"))


def _feature_kind(bits: DataFrame) -> str:
    kinds = dict(bits.dtypes)
    return kinds["feature"] if "feature" in kinds else kinds["features"][len("array<") : -1]


def _cells() -> list[tuple[Column, Column]]:
    """Observed and expected of the four cells."""
    a, r, c, n = (F.col(x).cast("double") for x in ("n11", "n1x", "nx1", "n"))
    return [(a, r * c / n), (r - a, r * (n - c) / n), (c - a, (n - r) * c / n), (n - r - c + a, (n - r) * (n - c) / n)]


def chi2(table: DataFrame) -> DataFrame:
    """Adds ``score``: sum of (observed - expected)^2 / expected over the four cells; empty expectations add nothing."""
    score = F.lit(0.0)
    for o, e in _cells():
        score = score + F.when(e > 0, (o - e) * (o - e) / e).otherwise(0.0)
    return table.withColumn("score", score)


def mutual_information(table: DataFrame) -> DataFrame:
    """Adds ``score``: mutual information of feature and label in nats."""
    score, n = F.lit(0.0), F.col("n").cast("double")
    for o, e in _cells():
        score = score + F.when((o > 0) & (e > 0), o / n * F.log(o / e)).otherwise(0.0)
    return table.withColumn("score", score)


def top(scored: DataFrame, k: int) -> DataFrame:
    """(feature, score, rank): the k best features by their best label."""
    best = scored.groupBy("feature").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "feature")) - 1).where(F.col("rank") < k)


def top_per_label(scored: DataFrame, k: int) -> DataFrame:
    """(label, feature, score, rank): the k best features of each label, for individual inputs."""
    w = Window.partitionBy("label").orderBy(F.desc("score"), "feature")
    return scored.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k).select("label", "feature", "score", "rank")


def bit_entropy(codes: DataFrame, bits: Column) -> DataFrame:
    """(bit, p, entropy) of array<int> bits over all rows; entropy in bits."""
    p = codes.select(F.posexplode(bits).alias("bit", "b")).groupBy("bit").agg(F.avg(F.col("b").cast("double")).alias("p"))
    part = lambda x: F.when((x > 0) & (x < 1), -x * F.log2(x)).otherwise(0.0)
    return p.withColumn("entropy", part(F.col("p")) + part(1 - F.col("p")))


def top_entropy(entropies: DataFrame, k: int) -> DataFrame:
    """The k bits of most entropy."""
    return entropies.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("entropy"), "bit")) - 1).where(F.col("rank") < k)
