"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks.

1. Sizes: words per document, summed per source. Targets: sources in code point order (null last) weigh by a repeating
   pattern and share the whole; a target stops at ``max_epochs`` times its source's size and the excess goes to the rest
   by weight. That water level has a closed form over the sources sorted by size / weight.
2. Blocks of ``block`` words are allotted to sources by highest quotients target / (2k + 1), then each source's blocks
   to its shards likewise (a shard is a keyed hash of the document, so a source of any size spreads over many). The
   allotment is exact, but only quotients near the cut are listed, about two a source or shard.
3. In a shard, documents lie in seeded order as one circle of words cut into blocks; after whole epochs the remaining
   blocks are a run of blocks that begins at a seeded one. A document gets the words of its own that these blocks hold.

Only ids, sources and sizes are ever shuffled. What is per source or per shard is a table of sums.

Nulls: a null text has size 0, the null source is a source of its own, sorted last; a null id is a document like others.
Empty texts: size 0, nothing taken. Ties in the seeded order fall to the id; repeated rows are documents of their own,
ordered among themselves arbitrarily but alike in size, so that the sums agree. Very long texts
are sized and cut whole. Empty table: an empty result. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: documents that a shard holds about; blocks per source that the whole is cut into, at most MAX_BLOCK words each
SHARD_DOCS = 4_000
BLOCKS_PER_SOURCE = 2_000
MAX_BLOCK = 1_024


def keyed(*parts: Column) -> Column:
    """A 32-bit number from md5, alike on every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", *more: Column) -> DataFrame:
    return docs.select(*more, F.col(key).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS, block: int | None = None) -> DataFrame:
    """Per source: source_size, n_docs, weight, target, block, quota (blocks). One row a source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1))
    w = w.withColumn("cap", max_epochs * F.col("source_size").cast("double")).withColumn("level", F.col("cap") / F.col("weight"))
    up = Window.orderBy("level", F.col("source").asc_nulls_last())
    to_here = up.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("total", F.sum("source_size").over(everything)).withColumn("n", F.count(F.lit(1)).over(everything))
    w = w.withColumn("capped", F.coalesce(F.sum("cap").over(to_here), F.lit(0.0))).withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(to_here), F.lit(0.0)))
    # With all before this one capped, the level of the rest; the true level is the first that its own cap reaches.
    w = w.withColumn("try", (F.col("total") - F.col("capped")) / F.col("open"))
    w = w.withColumn("lambda", F.max(F.when(F.col("level") >= F.col("try"), F.col("try"))).over(everything))
    w = w.withColumn("target", F.round(F.least(F.col("cap"), F.coalesce(F.col("lambda"), F.lit(0.0)) * F.col("weight")), 6))
    size = F.lit(block) if block else F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCK), F.floor(F.col("total") / (BLOCKS_PER_SOURCE * F.col("n")))))
    w = w.withColumn("block", size.cast("long")).withColumn("seats", F.round(F.col("total") / F.col("block")).cast("long"))
    return apportion(w, "target", "seats", [], ["source"]).select("source", "source_size", "n_docs", "weight", "target", "block", "quota")


def apportion(cells: DataFrame, weight: str, seats: str, within: list[str], ties: list[str]) -> DataFrame:
    """Adds ``quota``: Sainte-Lague seats of each cell, ``seats`` in each group ``within``; ties by the columns ``ties``.

    A cell of weight w has floor(w / u + 1 / 2) quotients w / (2k + 1) of at least u / 2. Of n cells that is between
    sum / u - n / 2 and sum / u + n / 2, so at u = sum / (seats - n / 2) none too many are given and at u = sum / (seats +
    n / 2) enough; only the quotients between these two, some 2 n in all, are ranked. Groups without weight get no seat.
    """
    g = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    w, sure = F.col(weight).cast("double"), F.col(seats) - F.col("_n") / 2
    c = cells.withColumn("_sum", F.sum(F.col(weight).cast("double")).over(g)).withColumn("_n", F.count(F.lit(1)).over(g))
    some = (F.col(seats) > 0) & (w > 0)
    given = lambda n: F.floor(w * n / F.col("_sum") + 0.5)
    c = c.withColumn("_q0", F.when(some & (sure > 0), F.greatest(given(sure) - 1, F.lit(0))).otherwise(0).cast("long"))
    c = c.withColumn("_q1", F.when(some, given(F.col(seats) + F.col("_n") / 2) + 1).otherwise(0).cast("long"))
    c = c.withColumn("_more", F.col(seats) - F.sum("_q0").over(g))
    keys = [*within, *ties]
    offers = c.where("_q1 > _q0").select(*keys, "_more", F.col(weight).alias("_w"), F.explode(F.sequence("_q0", F.col("_q1") - 1)).alias("_k"))
    # of equal quotients the first cell is served first
    best = g.orderBy((F.col("_w").cast("double") / (2 * F.col("_k") + 1)).desc(), *[F.col(t).asc_nulls_last() for t in ties])
    changed = offers.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= F.col("_more")).groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("_change"))
    same = None
    for i, k in enumerate(keys):
        e = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        same = e if same is None else same & e
    return c.join(changed, same, "left").withColumn("quota", F.col("_q0") + F.coalesce(F.col("_change"), F.lit(0))).drop("_sum", "_n", "_q0", "_q1", "_more", "_change", *[f"_k{i}" for i in range(len(keys))])


def _placed(docs: DataFrame, key: str, text: str, source: str, weights: tuple, max_epochs: int, seed: str, block: int | None, shard_docs: int, carry: bool) -> DataFrame:
    """Each document with the words it gives: whole (times), head_from, head (words), tail (words from its start)."""
    sized = sizes(docs, key, text, source)
    plan = targets(sized, weights, max_epochs, block)
    src = plan.select(F.col("source").alias("_s"), "source_size", "target", "block", "quota", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / shard_docs)).cast("long").alias("n_shards"))

    def sharded(rows: DataFrame) -> DataFrame:
        idtext = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
        d = rows.join(src, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        return d.withColumn("order", keyed(F.lit(seed), idtext)).withColumn("shard", F.pmod(keyed(F.lit(seed + "-shard"), idtext), F.col("n_shards")))

    cells = sharded(sized).groupBy("source", "shard").agg(F.sum("size").alias("cell_size"), F.first("quota").alias("quota_s"))
    cells = apportion(cells, "cell_size", "quota_s", ["source"], ["shard"]).select(F.col("source").alias("_s"), F.col("shard").alias("_h"), "cell_size", F.col("quota").alias("cell_quota"))
    d = sharded(sizes(docs, key, text, source, F.struct("*").alias("row")) if carry else sized)
    d = d.join(cells, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h"))).drop("_s", "_h")
    w = Window.partitionBy("source", "shard").orderBy("order", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("a", F.coalesce(F.sum("size").over(w), F.lit(0)))
    d = d.withColumn("want", F.least(F.col("cell_quota") * F.col("block"), max_epochs * F.col("cell_size")))
    d = d.withColumn("whole", F.when(F.col("cell_size") > 0, F.floor(F.col("want") / F.col("cell_size"))).otherwise(0).cast("long"))
    d = d.withColumn("rest", F.col("want") - F.col("whole") * F.col("cell_size"))
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("cell_size") / F.col("block"))).cast("long")
    d = d.withColumn("from", F.pmod(keyed(F.lit(seed + "-block"), F.coalesce(F.col("source"), F.lit("")), F.col("shard").cast("string")), n_blocks) * F.col("block"))
    end = F.col("from") + F.col("rest")
    lap = lambda lo, hi: F.greatest(F.lit(0), F.least(F.col("a") + F.col("size"), hi) - F.greatest(F.col("a"), lo)).cast("long")
    return d.withColumn("head", lap(F.col("from"), F.least(end, F.col("cell_size")))).withColumn("head_from", F.greatest(F.lit(0), F.col("from") - F.col("a"))).withColumn("tail", lap(F.lit(0), end - F.col("cell_size")))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, block: int | None = None, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of each document."""
    d = _placed(docs, key, text, source, weights, max_epochs, seed, block, shard_docs, False)
    return d.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("head") + F.col("tail")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, block: int | None = None, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time a document is taken whole, and one for each part.

    A part is its words joined by single blanks. A document that gives no word isn't in the mix.
    """
    d = _placed(docs, key, text, source, weights, max_epochs, seed, block, shard_docs, True)
    t = F.col(f"row.`{text}`")
    cut = lambda lo, n: F.array_join(F.slice(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), (lo + 1).cast("int"), n.cast("int")), " ")
    none = F.lit(None).cast("string")
    n, size = F.col("whole"), F.col("size")
    head = F.when(F.col("head") == 0, none).when(F.col("head") == size, t).otherwise(cut(F.col("head_from"), F.col("head")))
    tail = F.when(F.col("tail") == 0, none).when(F.col("tail") == size, t).otherwise(cut(F.lit(0), F.col("tail")))
    times = F.when((size > 0) & (n > 0), F.array_repeat(t, n.cast("int"))).otherwise(F.array().cast("array<string>"))
    rows = d.select("row", F.explode(F.concat(times, F.array_compact(F.array(head, tail)))).alias("_taken"))
    return rows.select(*[F.col("_taken").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
