"""Dataset scans and exact splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitweave.functions.text import clean_posting
from bitweave.operators.setjoin import hash_number


def binary_matrix(spark: SparkSession, path: str, n_features: int, most: int | None = None) -> DataFrame:
    """(id, features, label) of a text file of 0/1 tokens and a label a line; ids in order of the lines, blank ones skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("_m", F.monotonically_increasing_id())
    t = F.split(F.trim("value"), r"\s+")
    on = F.filter(F.transform(F.slice(t, 1, n_features), lambda x, i: F.when(x == "1", i.cast("long"))), lambda i: i.isNotNull())
    rows = lines.select("_m", on.alias("features"), F.element_at(t, n_features + 1).cast("int").alias("label"))
    from bitweave.operators.pairs import numbered

    nums = numbered(rows, "_m").select(F.col("id").alias("_m"), F.col("row").alias("id"))  # dense, whatever the splits
    rows = rows.join(nums, "_m").select("id", "features", "label")
    return rows.where(F.col("id") < most) if most else rows


def bits(rows: DataFrame, n_features: int) -> DataFrame:
    """Flat positions id * n_features + feature."""
    return rows.select("id", F.explode("features").alias("f")).select((F.col("id") * n_features + F.col("f")).alias("position"))


def text_folders(spark: SparkSession, path: str, labels: dict[str, int] | None = None, most: int | None = None, clean: bool = False, seed: str = "order") -> DataFrame:
    """(id, category, label, text, path) of path/<category>/<file>, in keyed order; at most ``most`` a category.

    Labels follow the categories' names unless given, e.g. {"pos": 1, "neg": 0}.
    """
    raw = spark.read.text(f"{path}/*/*", wholetext=True).withColumn("path", F.input_file_name())
    d = raw.withColumn("category", F.element_at(F.split("path", "/"), -2))
    order = hash_number(F.lit(seed), F.concat_ws("/", "category", F.element_at(F.split("path", "/"), -1)))
    d = d.withColumn("_o", order).withColumn("_r", F.row_number().over(Window.partitionBy("category").orderBy("_o", "path")))
    if most:
        d = d.where(F.col("_r") <= most)
    if labels:
        label = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))])[F.col("category")]
    else:
        names = [r["category"] for r in d.select("category").distinct().orderBy("category").collect()]
        label = F.create_map(*[x for i, k in enumerate(names) for x in (F.lit(k), F.lit(i))])[F.col("category")] if names else F.lit(0)
    text = clean_posting(F.col("value")) if clean else F.col("value")
    from bitweave.operators.pairs import numbered

    # only keys are numbered, never texts in one task; the hash comes first, so that its order is that of the number
    nums = numbered(d.select(F.struct("_o", "path").alias("_k")), "_k").select(F.col("id.path").alias("path"), F.col("row").alias("id"))
    return d.join(nums, "path").select("id", "category", label.cast("int").alias("label"), text.alias("text"), "path")


def split(rows: DataFrame, ratio: float, validation: float = 0.0, order: str = "id") -> DataFrame:
    """Adds ``split``: the first floor(n * ratio) rows train, of which the last floor(train * validation) validate; the rest test.

    Bounds are exact. Row numbers come from counts per range, so no task sees all rows.
    """
    from bitweave.operators.pairs import numbered

    nums = numbered(rows, order)
    n = nums.count()
    cut = int(n * ratio)
    held = int(cut * validation)
    name = F.when(F.col("row") < cut - held, "train").when(F.col("row") < cut, "validate").otherwise("test")
    return rows.join(nums.select(F.col("id").alias(order), name.alias("split")), order)


def train_test_folders(spark: SparkSession, train: str, test: str, validation: float = 0.0, **options) -> DataFrame:
    """Both folders with ``split``; the last floor(n * validation) of train validate."""
    a, b = text_folders(spark, train, **options), text_folders(spark, test, **options)
    n = a.count()
    a = a.withColumn("split", F.when(F.col("id") < n - int(n * validation), "train").otherwise("validate"))
    return a.unionByName(b.withColumn("id", F.col("id") + n).withColumn("split", F.lit("test")))


def classes_index(rows: DataFrame, id: str = "id", name: str = "class") -> DataFrame:
    """(id, feature): dense class numbers in order of each class's first id."""
    first = rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(id).alias("_f"))
    nums = first.withColumn("feature", (F.row_number().over(Window.orderBy("_f")) - 1).cast("long")).drop("_f")
    return rows.join(nums, name).select(id, "feature")
