"""Binary codes as arrays of 32-bit words in longs, lowest bit first: packing, fetching, distances, literals.

Words are positive, so that every engine agrees on them. All of it is built-in expressions inside whole-stage code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 32


def pack(bits: Column, n: int) -> Column:
    """array<int> of n zeros and ones to words; places beyond n are 0."""
    words = []
    for w in range(0, n, WORD):
        own = F.slice(bits, w + 1, min(WORD, n - w))
        words.append(F.aggregate(F.transform(own, lambda b, i: F.call_function("shiftleft", b.cast("long"), i)), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)))
    return F.array(*words)


def unpack(code: Column, n: int) -> Column:
    """Words to array<int> of n zeros and ones."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.getbit(F.element_at(code, F.floor(i / WORD).cast("int") + 1), (i % WORD).cast("int")).cast("int"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two codes of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def distance(a: Column, b: Column, n: int) -> Column:
    """Differing bits as a share of n; 1 where a code is missing."""
    return F.coalesce(hamming(a, b) / F.lit(float(n)), F.lit(1.0))


def similarity(a: Column, b: Column, n: int) -> Column:
    """1 - distance; 0 where a code is missing."""
    return F.lit(1.0) - distance(a, b, n)


def fetch(index: DataFrame, ids: DataFrame, n: int, id: str = "id", code: str = "code") -> DataFrame:
    """The codes of ``ids``, in a row each; all zeros where the index has none."""
    zero = F.array(*[F.lit(0).cast("long")] * (-(-n // WORD)))
    return ids.join(index.select(id, code), id, "left").withColumn(code, F.coalesce(code, zero))


def low_bits(code: Column, n: int) -> Column:
    """The low word of a code, masked to n bits, for the exact index of short codes."""
    if n > WORD:
        raise ValueError(f"the exact index holds at most {WORD} bits")
    return F.element_at(code, 1).bitwiseAND(F.lit((1 << n) - 1))


def literals(bits: Column, k: int) -> Column:
    """k features to the 2k literals of a clause machine: the set ones, then k + f for each f that isn't set."""
    absent = F.array_except(F.sequence(F.lit(0), F.lit(k - 1)).cast("array<bigint>"), bits.cast("array<bigint>"))
    return F.concat(bits.cast("array<bigint>"), F.transform(absent, lambda f: f + k))


def to_sets(bits: DataFrame, id: str = "id", feature: str = "feature") -> DataFrame:
    """Long form (id, feature) to one ascending array a row."""
    return bits.groupBy(id).agg(F.array_sort(F.collect_set(feature)).alias("features"))


def select(bits: DataFrame, features: DataFrame | None = None, ids: DataFrame | None = None, id: str = "id", feature: str = "feature") -> DataFrame:
    """Keeps listed features, renumbered by their ``rank`` column, and listed ids."""
    out = bits
    if features is not None:
        out = out.join(features.select(F.col(feature), F.col("rank").alias("_r")), feature).drop(feature).withColumnRenamed("_r", feature)
    if ids is not None:
        out = out.join(ids.select(id).distinct(), id, "left_semi")
    return out.select(id, feature)


def extend(left: DataFrame, right: DataFrame, n_left: int, id: str = "id", feature: str = "feature") -> DataFrame:
    """Appends a second block of features behind the first n_left."""
    return left.select(id, feature).unionByName(right.select(id, (F.col(feature) + n_left).alias(feature)))


def individualize(bits: DataFrame, groups: DataFrame, id: str = "id", feature: str = "feature") -> DataFrame:
    """(group, id, feature) with each group's own selection, numbered by its ``rank``: one input per class or output bit."""
    g = groups.select(F.col("group"), F.col(feature).alias("_f"), F.col("rank").alias("_r"))
    return bits.join(g, bits[feature] == g["_f"]).select("group", id, F.col("_r").alias(feature))


def add_scaled(labels: Column, row: Column, scale: int) -> Column:
    """Flat position of a row's label in a matrix of ``scale`` columns."""
    return row * scale + labels
