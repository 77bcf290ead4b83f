"""Sampled pairs and spanning trees. All randomness is a keyed md5, so results don't depend on partitioning or time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitweave.operators.graph import spanning_forest
from bitweave.operators.setjoin import hash_number


def numbered(ids: DataFrame, id: str = "id") -> DataFrame:
    """(id, row) with rows 0, 1, ... by id: numbers within ranges of ids plus the rows before each range."""
    slim = ids.select(F.col(id).alias("id")).distinct()
    parts = slim.repartitionByRange("id").withColumn("_p", F.spark_partition_id())
    from bitweave.session import stage

    parts = stage(parts, "numbered")
    sizes = {r["_p"]: r["n"] for r in parts.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}  # one number a partition
    before, at = {}, 0
    for p in sorted(sizes):
        before[p] = at
        at += sizes[p]
    offset = F.element_at(F.create_map(*[x for p, b in before.items() for x in (F.lit(p), F.lit(b))]), F.col("_p")) if before else F.lit(0)
    return parts.withColumn("row", (F.row_number().over(Window.partitionBy("_p").orderBy("id")) - 1 + offset).cast("long")).drop("_p")


def random_pairs(ids: DataFrame, per_node: int, seed: str = "pairs") -> DataFrame:
    """(src, dst): per row ``per_node`` draws of another row, by keyed hash; src is the smaller, repeats merged."""
    rows = numbered(ids)
    n = rows.count()
    if n < 2:
        return rows.select(F.col("id").alias("src"), F.col("id").alias("dst")).limit(0)
    draw = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))))
    other = (F.col("row") + 1 + hash_number(F.lit(seed), F.col("id").cast("string"), F.col("j").cast("string")) % (n - 1)) % n
    met = draw.withColumn("other", other).join(rows.select(F.col("row").alias("other"), F.col("id").alias("o")), "other")
    return met.select(F.least("id", "o").alias("src"), F.greatest("id", "o").alias("dst")).distinct()


def multiclass_pairs(labels: DataFrame, n_pos: int, n_neg: int, seed: str = "classes") -> tuple[DataFrame, DataFrame]:
    """(positive, negative) pairs (src, dst): each row with anchors of its own class, and with rows of others.

    Anchors are the first of a class in keyed order; negatives are anchors of the classes that follow, in turn.
    """
    lab = labels.select("id", "label").where("label is not null")
    w = Window.partitionBy("label").orderBy(hash_number(F.lit(seed), F.col("id").cast("string")), "id")
    anchors = lab.withColumn("r", F.row_number().over(w)).where(F.col("r") <= max(n_pos, n_neg)).select(F.col("id").alias("a"), F.col("label").alias("al"), "r")
    order = lambda x, y: (F.least(x, y).alias("src"), F.greatest(x, y).alias("dst"))
    pos = lab.join(anchors.where(F.col("r") <= n_pos), F.col("label") == F.col("al")).where("id <> a").select(*order("id", "a")).distinct()
    classes = [r["label"] for r in lab.select("label").distinct().orderBy("label").collect()]  # classes are few
    if len(classes) < 2:
        return pos, pos.limit(0)
    kind = dict(lab.dtypes)["label"]
    follow = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c).cast(kind), F.array(*[F.lit(classes[(i + d) % len(classes)]).cast(kind) for d in range(1, len(classes))]))])
    pick = lab.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_neg - 1))))
    others = F.element_at(follow, F.col("label"))
    pick = pick.withColumn("al", F.element_at(others, (hash_number(F.lit(seed), F.col("id").cast("string"), F.col("j").cast("string")) % (len(classes) - 1) + 1).cast("int"))).withColumn("r", F.col("j") + 1)
    neg = pick.join(anchors, ["al", "r"]).select(*order("id", "a")).distinct()
    return pos, neg


def maximum_spanning_tree(edges: DataFrame) -> DataFrame:
    """(src, dst, weight) of a spanning forest of the heaviest edges."""
    return spanning_forest(edges.select("src", "dst", (-F.col("weight")).alias("dist"))).select("src", "dst", (-F.col("dist")).alias("weight"))
