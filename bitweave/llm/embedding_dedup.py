"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosines, connected components.

1. Equal vectors of a label become one class (smallest id, multiplicity), so copies never meet each other.
2. Each class gets a signature of ``bits`` signs in each of ``tables`` tables. Classes that agree in a table share a
   bucket of that table. Bits grow with the logarithm of the classes of the largest label, so that unlike vectors seldom
   meet however many there are; tables are then as many as find a pair at the threshold with probability 1 - ``miss``. At
   a cosine of 0.93 a sign agrees with probability 0.88: 13 bits agree with 0.19, and one of 34 tables does with 0.9993.
3. A bucket above ``tile`` classes is cut into chunks by a keyed hash, and each pair of chunks is a task of its own, so
   a bucket that holds a third of all rows spreads over the cluster. In a tile all cosines are exact, in double
   precision; pairs stay inside it: out come, per class, the number of vectors linked (a pair counts in the first table
   in which it agrees) and one edge to the smallest class of its component within the tile.
4. Links are summed per class; components come from the edges.

Nulls: a vector that is null, empty, zero or holds null or non-finite components links with nothing, nor does one with a
null label; each such row is a component of itself. Vectors of different length never compare. Ties and repeated rows:
rows that share an id are one node, whose links
are those of all its vectors together, and each has a row in the result. Empty table: an empty result.
Other columns are ignored, whatever their names. Nothing in the result depends on the order of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitweave.operators.components import connected_components
from bitweave.session import cut

MISS, TILE, SEED = 7e-4, 1024, 20240229


def tuned(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Bits and tables for n classes in the largest label."""
    bits = min(32, max(6, math.ceil(math.log2(max(n, 1)))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-agree))) if agree < 1 else 1


def planes(dim: int, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))


def sig_type(bits: int) -> str:
    return "<u2" if bits <= 16 else "<u4"


def signatures(x: np.ndarray, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    s = (x @ planes(x.shape[1], bits, tables, seed)) >= 0
    return (s.reshape(len(x), tables, bits) * (1 << np.arange(bits, dtype=np.int64))).sum(2).astype(sig_type(bits))


def _sign(bits: int, tables: int, vec_type: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            for _, g in pdf.groupby(pdf["embedding"].map(len)):
                x = np.stack(g["embedding"].to_numpy()).astype("<f8")
                s = signatures(x / np.linalg.norm(x, axis=1, keepdims=True), bits, tables)
                yield pd.DataFrame({"rep": g["rep"].to_numpy(), "label": g["label"].to_numpy(), "dim": x.shape[1], "mult": g["mult"].to_numpy(), "vec": [v.tobytes() for v in x.astype(vec_type)], "sig": [v.tobytes() for v in s]})

    return run


def _settle(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index of each node's component under the pairs (i, j)."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        new = a != b
        if not new.any():
            break
        i, j, a, b = i[new], j[new], a[new], b[new]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def tile_links(tile: np.ndarray, t: np.ndarray, side: np.ndarray, rep: np.ndarray, mult: np.ndarray, x: np.ndarray, sig: np.ndarray, threshold: float, small: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row and the smallest row of its component, over whole tiles that are sorted by tile and rep.

    Pairs of small tiles are taken by their distance in the sorted rows, all tiles at once; a larger tile is a matrix
    product of its own, a stretch of rows at a time. ``rep`` ascends within a tile, so the smallest row is the smallest id.
    """
    n = len(tile)
    links, root = np.zeros(n, np.int64), np.arange(n)
    first = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
    length = np.diff(np.r_[first, n])
    begin, size = np.repeat(first, length), np.repeat(length, length)

    def count(i: np.ndarray, j: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of linked pairs, those that no table before table k has in one bucket."""
        ok = (side[i] == 2) | (side[i] != side[j])
        i, j, k = i[ok], j[ok], k[ok]
        same = sig[i] == sig[j]
        ok = np.where(same.any(1), same.argmax(1), 1 << 30) >= k
        i, j = i[ok], j[ok]
        np.add.at(links, i, mult[j])
        np.add.at(links, j, mult[i])
        return i, j

    some_i, some_j = [], []
    rows = np.flatnonzero((size <= small) & (size > 1))
    for d in range(1, small):
        i = rows[rows + d < (begin + size)[rows]]
        if not len(i):
            break
        j = i + d
        hit = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
        i, j = count(i[hit], j[hit], t[i[hit]])
        some_i.append(i)
        some_j.append(j)
    if some_i:
        root = _settle(n, np.concatenate(some_i), np.concatenate(some_j))
    for f, m in zip(first[length > small], length[length > small]):
        own, all_i, all_j = np.arange(f, f + m), [], []
        for lo in range(f, f + m, 128):
            left = np.arange(lo, min(lo + 128, f + m))
            hit = (x[left] @ x[own].T >= threshold) & (own[None, :] > left[:, None])
            a, b = np.nonzero(hit)
            i, j = count(left[a], own[b], np.full(len(a), t[f]))
            all_i.append(i - f)
            all_j.append(j - f)
        root[own] = f + _settle(m, np.concatenate(all_i), np.concatenate(all_j))
    return links, root


def _link(threshold: float, vec_type: str, sig_type: str):
    """Streams rows sorted by tile; a tile is bounded by the chunks it was cut into, so what is held is too."""

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((pdf["rep"].to_numpy(), codes := pd.factorize(pdf["tile"])[0]))
        pdf, codes = pdf.iloc[order], codes[order]
        rep = pdf["rep"].to_numpy()
        out = []
        lens = pdf["vec"].map(len).to_numpy()
        for size in np.unique(lens):  # tiles never mix lengths
            at = np.flatnonzero(lens == size)
            part = pdf.iloc[at]
            x = np.frombuffer(b"".join(part["vec"]), vec_type).reshape(len(at), -1).astype("<f8")
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            sig = np.frombuffer(b"".join(part["sig"]), sig_type).reshape(len(at), -1)
            links, root = tile_links(codes[at], part["t"].to_numpy(), part["side"].to_numpy(), rep[at], part["mult"].to_numpy(), x, sig, threshold)
            some = np.flatnonzero(links)
            out.append(pd.DataFrame({"rep": rep[at][some], "links": links[some], "root": rep[at][root[some]]}))
        return pd.concat(out).astype("int64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            last = pdf["tile"].iloc[-1]
            cut_at = int((pdf["tile"] != last).to_numpy().sum()) if not (pdf["tile"] == last).all() else 0
            # rows are sorted by tile, so those before cut_at are whole tiles with what is held
            if held and cut_at == 0 and held[-1]["tile"].iloc[-1] != last:
                yield whole(pd.concat(held))
                held = [pdf]
            elif cut_at == 0:
                held.append(pdf)
            else:
                yield whole(pd.concat([*held, pdf.iloc[:cut_at]]))
                held = [pdf.iloc[cut_at:]]
        if held:
            yield whole(pd.concat(held))

    return run


def near_duplicates(rows: DataFrame, key: str = "vec_id", vec: str = "embedding", label: str = "label", threshold: float = 0.93, bits: int | None = None, tables: int | None = None, miss: float = MISS, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row."""
    vec_type = "<f4" if dict(rows.dtypes)[vec] == "array<float>" else "<f8"  # either way cosines are of doubles
    d = rows.select(F.col(key).alias("vec_id"), F.col(vec).cast("array<double>").alias("embedding"), F.col(label).alias("label"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    some = F.exists("embedding", lambda v: v != 0)
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & some, F.lit(False))
    d = d.withColumn("good", good)
    classes = d.where("good").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"))
    most = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    own_bits, own_tables = tuned(most, threshold, miss)
    bits, tables = bits or own_bits, tables or own_tables
    width = int(sig_type(bits)[-1])
    kind = dict(d.dtypes)["label"]
    signed = cut(classes.mapInPandas(_sign(bits, tables, vec_type), f"rep long, label {kind}, dim int, mult long, vec binary, sig binary"))
    keys = signed.select("rep", "label", "dim", "sig").select("rep", "label", "dim", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda i: F.substring("sig", i * width + 1, F.lit(width)))).alias("t", "bucket"))
    counts = keys.groupBy("label", "dim", "t", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / tile).cast("int")
    placed = keys.join(counts, ["label", "dim", "t", "bucket"]).withColumn("parts", parts).withColumn("chunk", F.pmod(F.hash("rep"), F.col("parts")))
    # a chunk meets itself (side 2) and every other chunk, as the left side (0) of later ones and the right (1) of earlier
    tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "rep",
        F.concat_ws(":", F.col("label").cast("string"), "dim", "t", F.hex("bucket"), F.least("chunk", "other"), F.greatest("chunk", "other")).alias("tile"),
        "t",
        F.when(F.col("chunk") == F.col("other"), 2).when(F.col("chunk") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    body = tiles.join(signed.select("rep", "mult", "vec", "sig"), "rep")
    found = cut(body.repartition("tile").sortWithinPartitions("tile").mapInPandas(_link(threshold, vec_type, sig_type(bits)), "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = connected_components(found.where("rep <> root"), "rep", "root")
    per_class = classes.join(links, "rep", "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("label", "embedding", "rep", "mult", "links", "component")
    own = d.where("good").join(per_class, ["label", "embedding"], "left").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    rest = d.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return own.unionByName(rest).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
