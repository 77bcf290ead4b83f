"""Booleanizer: attributes to bits, categorical by value, continuous by thresholds over distinct values.

Input in entity-attribute-value form: (id, attr, value_str, value_num). An attribute is continuous if declared so;
otherwise categorical if declared or if any of its values is text. ``fit`` gives the bit table, a small dimension table:
(bit, attr, kind, value_str, threshold, place). Bits are numbered by attribute, then value or threshold, whatever order
rows come in. Null values are not observed and set no bit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Booleanizer:
    n_thresholds: int = 0
    continuous: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()

    def observe(self, rows: DataFrame) -> DataFrame:
        """Distinct (attr, value_str, value_num); partially aggregated before the shuffle."""
        seen = rows.where("attr is not null and (value_str is not null or value_num is not null)")
        return seen.select("attr", "value_str", F.col("value_num").cast("double").alias("value_num")).distinct()

    def fit(self, rows: DataFrame) -> DataFrame:
        seen = self.observe(rows)
        text = seen.groupBy("attr").agg(F.max(F.col("value_str").isNotNull()).alias("text"))  # attributes are few, their values aren't
        forced = F.when(F.col("attr").isin(*self.continuous), F.lit(False)).when(F.col("attr").isin(*self.categorical), F.lit(True)) if self.continuous or self.categorical else F.lit(None).cast("boolean")
        seen = seen.join(F.broadcast(text), "attr").withColumn("is_cat", F.coalesce(forced, F.col("text"))).drop("text")
        cats = seen.where("is_cat").select("attr", F.coalesce("value_str", F.col("value_num").cast("string")).alias("value_str")).distinct()
        cats = cats.select("attr", F.lit("categorical").alias("kind"), "value_str", F.lit(None).cast("double").alias("threshold"))
        number = F.coalesce("value_num", F.expr("try_cast(value_str as double)"))
        nums = seen.where("not is_cat").select("attr", number.alias("v")).where("v is not null").distinct()
        conts = thresholds(nums, self.n_thresholds).select("attr", F.lit("continuous").alias("kind"), F.lit(None).cast("string").alias("value_str"), "threshold")
        order = Window.orderBy("attr", "kind", "value_str", "threshold")
        place = Window.partitionBy("attr").orderBy("kind", "value_str", "threshold")
        both = cats.unionByName(conts)
        return both.withColumn("place", (F.row_number().over(place) - 1).cast("long")).withColumn("bit", (F.row_number().over(order) - 1).cast("long"))


def thresholds(values: DataFrame, n: int) -> DataFrame:
    """(attr, threshold) over distinct (attr, v).

    n = 0: the middle of the largest gap between neighbours, the mean if there is no gap. At most n distinct values: all
    of them. Otherwise n linear quantiles at (i + 1) / (n + 1) of the distinct values.
    """
    if n == 0:
        w = Window.partitionBy("attr").orderBy("v")
        gaps = values.withColumn("before", F.lag("v").over(w)).withColumn("gap", F.col("v") - F.col("before"))
        best = gaps.groupBy("attr").agg(F.max(F.when(F.col("gap") > 0, F.struct("gap", (-F.col("v")).alias("m"), "before"))).alias("b"), F.avg("v").alias("mean"))
        return best.select("attr", F.coalesce((F.col("b.before") - F.col("b.m")) / 2, "mean").alias("threshold"))
    q = [(i + 1) / (n + 1) for i in range(n)]
    per = values.groupBy("attr").agg(F.count(F.lit(1)).alias("n"), F.percentile("v", q).alias("q"))
    few = values.join(per.where(F.col("n") <= n).select("attr"), "attr").select("attr", F.col("v").alias("threshold"))
    many = per.where(F.col("n") > n).select("attr", F.explode("q").alias("threshold"))
    return few.unionByName(many)


def encode(rows: DataFrame, bits: DataFrame, inclusive: bool = False) -> DataFrame:
    """(id, bit) of each value: its category, or the thresholds below it (``inclusive``: or equal to it, as for matrices)."""
    cat = bits.where("kind = 'categorical'").select("attr", F.col("value_str").alias("_t"), "bit")
    text = F.coalesce("value_str", F.col("value_num").cast("double").cast("string"))
    a = rows.withColumn("_t", text).join(cat, ["attr", "_t"]).select("id", "bit")  # by value too: an attribute holds any number of rows
    cont = bits.where("kind = 'continuous'").groupBy("attr").agg(F.collect_list(F.struct("threshold", "bit")).alias("ts"))
    x = F.coalesce(F.col("value_num").cast("double"), F.expr("try_cast(value_str as double)"))
    over = (lambda t: F.col("_x") >= t["threshold"]) if inclusive else (lambda t: F.col("_x") > t["threshold"])
    b = rows.withColumn("_x", x).where("_x is not null").join(F.broadcast(cont), "attr").select("id", F.explode(F.filter("ts", over)).alias("t")).select("id", "t.bit")
    return a.unionByName(b).distinct()


def matrix(rows: DataFrame, id: str, vec: str, first: int = 0) -> DataFrame:
    """A dense matrix in entity-attribute-value form, attributes numbered from ``first``."""
    return rows.select(F.col(id).alias("id"), F.posexplode(vec).alias("p", "v")).select("id", (F.col("p") + first).cast("string").alias("attr"), F.lit(None).cast("string").alias("value_str"), F.col("v").cast("double").alias("value_num"))


def features(bits: DataFrame) -> DataFrame:
    """Number of bits."""
    return bits.agg(F.count(F.lit(1)).alias("n_features"))


def feature(bits: DataFrame, attr: str, value: str | None = None, place: int = 0) -> DataFrame:
    """The bit of an attribute's value, or of its threshold ``place``."""
    own = bits.where(F.col("attr") == attr)
    return (own.where(F.col("value_str") == value) if value is not None else own.where(F.col("place") == place)).select("bit")


def index(bits: DataFrame) -> DataFrame:
    """(bit, name) of every bit."""
    return bits.select("bit", F.concat_ws(" ", "attr", F.when(F.col("kind") == "categorical", F.concat(F.lit("= "), "value_str")).otherwise(F.concat(F.lit("> "), F.col("threshold").cast("string")))).alias("name"))


def restrict(bits: DataFrame, attrs: list[str]) -> DataFrame:
    """Keeps the listed attributes and renumbers their bits without gaps."""
    return bits.where(F.col("attr").isin(*attrs)).withColumn("bit", (F.row_number().over(Window.orderBy("bit")) - 1).cast("long"))
