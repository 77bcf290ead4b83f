"""Laplacian eigenvectors of a weighted graph.

Small graphs (``dense_nodes`` at most) are solved densely on the driver, whose memory that number bounds. Larger ones that
are narrow, such as rings and chains, are solved there by levels, with a bound on what that holds. All others go through
subspace iteration with a Chebyshev filter, whose products are joins of the edges with the block of vectors; only
block x block sums reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitweave.operators.graph import symmetric
from bitweave.session import stage

DENSE_NODES = 3_000
#: Nodes, entries off the diagonal and numbers of the factors that the driver holds at most where it solves by levels.
LEVEL_NODES, LEVEL_ENTRIES, LEVEL_CELLS = 1_000_000, 6_000_000, 50_000_000


def laplacian(edges: DataFrame, nodes: DataFrame, kind: str = "unnormalized") -> tuple[DataFrame, DataFrame]:
    """(i, j, v) off the diagonal and (i, diag, scale) of the Laplacian; ``edges`` (src, dst, weight) once each.

    unnormalized: D - W. normalized and random: with a self-loop of weight 1 a node, scale 1 / sqrt(1 + degree).
    """
    both = symmetric(edges.select("src", "dst", "weight"))
    deg = nodes.select(F.col("id").alias("i")).distinct().join(both.groupBy(F.col("src").alias("i")).agg(F.sum("weight").alias("d")), "i", "left").withColumn("d", F.coalesce("d", F.lit(0.0)))
    if kind == "unnormalized":
        return both.select(F.col("src").alias("i"), F.col("dst").alias("j"), (-F.col("weight")).alias("v")), deg.select("i", F.col("d").alias("diag"), F.lit(1.0).alias("scale"))
    s = deg.select("i", (1.0 / F.sqrt(1.0 + F.col("d"))).alias("scale"))
    off = both.join(s.select(F.col("i").alias("src"), F.col("scale").alias("a")), "src").join(s.select(F.col("i").alias("dst"), F.col("scale").alias("b")), "dst")
    return off.select(F.col("src").alias("i"), F.col("dst").alias("j"), (-F.col("a") * F.col("b") * F.col("weight")).alias("v")), s.select("i", (1.0 - F.col("scale") * F.col("scale")).alias("diag"), "scale")


def matvec(off: DataFrame, diag: DataFrame, x: DataFrame, k: int) -> DataFrame:
    """(i, x array<double>) of the Laplacian times a block of k vectors (i, x)."""
    term = off.join(x.select(F.col("i").alias("j"), "x"), "j").select("i", *[(F.col("v") * F.element_at("x", c + 1)).alias(f"c{c}") for c in range(k)])
    own = diag.join(x, "i").select("i", *[(F.col("diag") * F.element_at("x", c + 1)).alias(f"c{c}") for c in range(k)])
    sums = term.unionByName(own).groupBy("i").agg(*[F.sum(f"c{c}").alias(f"c{c}") for c in range(k)])
    return sums.select("i", F.array(*[f"c{c}" for c in range(k)]).alias("x"))


def _product(a: DataFrame, b: DataFrame, k: int) -> np.ndarray:
    """A'B of two blocks, k x k."""
    j = a.join(b.select("i", F.col("x").alias("y")), "i")
    cells = [F.sum(F.element_at("x", p + 1) * F.element_at("y", q + 1)).alias(f"s{p}_{q}") for p in range(k) for q in range(k)]
    row = j.agg(*cells).first()
    return np.array([[row[f"s{p}_{q}"] for q in range(k)] for p in range(k)], float)


def _turn(a: DataFrame, m: np.ndarray) -> DataFrame:
    k = m.shape[0]
    cols = [sum((F.element_at("x", p + 1) * F.lit(float(m[p, q])) for p in range(1, k)), F.element_at("x", 1) * F.lit(float(m[0, q]))) for q in range(m.shape[1])]
    return a.select("i", F.array(*cols).alias("x"))


def _levels(n: int, i: np.ndarray, j: np.ndarray, least: int = 32) -> tuple[np.ndarray, np.ndarray] | None:
    """(order, begin): nodes by breadth-first levels, in blocks of whole levels, of ``least`` nodes or more; an edge stays in
    its block or goes to one beside it. None if that takes more than LEVEL_CELLS numbers. i is sorted.
    """
    start = np.searchsorted(i, np.arange(n + 1))
    seen, blocks, waiting, cells, at = np.zeros(n, bool), [], [], 0, 0

    def level(front: np.ndarray) -> np.ndarray:
        size = start[front + 1] - start[front]
        near = j[np.arange(size.sum()) + np.repeat(start[front] - np.cumsum(size) + size, size)]
        near = np.unique(near[~seen[near]])
        seen[near] = True
        return near

    alone = np.flatnonzero(start[1:] == start[:-1])
    seen[alone] = True
    blocks += [alone[b : b + least] for b in range(0, len(alone), least)]
    while at < n:
        if seen[at]:
            at += 1
            continue
        front, far = np.array([at]), at
        seen[at] = True
        mine = [front]
        while len(front := level(front)):
            mine.append(front)
        far, whole = mine[-1][0], np.concatenate(mine)
        seen[whole] = False  # again, from one of the farthest nodes: levels are narrower
        front = np.array([far])
        seen[far] = True
        while len(front):
            waiting.append(front)
            if sum(map(len, waiting)) >= least:
                blocks.append(np.concatenate(waiting))
                cells += len(blocks[-1]) ** 2 + (len(blocks[-1]) * len(blocks[-2]) if len(blocks) > 1 else 0)
                waiting = []
                if cells > LEVEL_CELLS:
                    return None
            front = level(front)
    if waiting:
        blocks.append(np.concatenate(waiting))
    return np.concatenate(blocks), np.cumsum([0, *map(len, blocks)])


def _by_levels(diag: np.ndarray, i: np.ndarray, j: np.ndarray, v: np.ndarray, want: int, rounds: int = 200) -> tuple[np.ndarray, np.ndarray] | None:
    """The ``want`` smallest eigenpairs of a Laplacian by inverse iteration: its blocks by levels are tridiagonal.

    Blocks are eliminated one behind the other, so time and memory grow with nodes times the width of a level.
    """
    n = len(diag)
    order = np.lexsort((j, i))
    i, j, v = i[order], j[order], v[order]
    found = _levels(n, i, j)
    if found is None:
        return None
    order, begin = found
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    a, b, d = place[i], place[j], diag[order]
    top = float((np.bincount(i, np.abs(v), n) + diag).max()) or 1.0
    shift = 1e-10 * top
    by = np.argsort(a, kind="stable")
    a, b, v = a[by], b[by], v[by]
    cut = np.searchsorted(a, begin)
    inverse, below, last = [], [], None
    for t in range(len(begin) - 1):
        first, size = begin[t], begin[t + 1] - begin[t]
        x, y, w = a[cut[t] : cut[t + 1]] - first, b[cut[t] : cut[t + 1]], v[cut[t] : cut[t + 1]]
        m = np.diag(d[first : first + size] + shift)
        own = (y >= first) & (y < first + size)
        np.add.at(m, (x[own], y[own] - first), w[own])
        if t:
            c = np.zeros((size, begin[t] - begin[t - 1]))
            back = y < first
            np.add.at(c, (x[back], y[back] - begin[t - 1]), w[back])
            m -= c @ last @ c.T
            below.append(c)
        last = np.linalg.inv(m)
        last = (last + last.T) / 2
        inverse.append(last)

    def solve(z: np.ndarray) -> np.ndarray:
        out = z.copy()
        for t in range(1, len(inverse)):
            out[begin[t] : begin[t + 1]] -= below[t - 1] @ (inverse[t - 1] @ out[begin[t - 1] : begin[t]])
        for t in range(len(inverse) - 1, -1, -1):
            own = out[begin[t] : begin[t + 1]]
            if t + 1 < len(inverse):
                own = own - below[t].T @ out[begin[t + 1] : begin[t + 2]]
            out[begin[t] : begin[t + 1]] = inverse[t] @ own
        return out

    def times(z: np.ndarray) -> np.ndarray:
        return np.stack([d * z[:, c] + np.bincount(a, v * z[b, c], n) for c in range(z.shape[1])], axis=1)

    z = np.random.default_rng(7).standard_normal((n, min(n, want + 6)))
    for _ in range(rounds):
        z, _r = np.linalg.qr(solve(z))
        lz = times(z)
        h = z.T @ lz
        values, turn = np.linalg.eigh((h + h.T) / 2)
        z, lz = z @ turn, lz @ turn
        left = np.linalg.norm(lz[:, :want] - z[:, :want] * values[:want], axis=0)
        if (left <= 1e-13 * top + 1e-9 * np.abs(values[:want])).all():
            break
    back = np.empty_like(z)
    back[order] = z
    return values[:want], back[:, :want]


def eigen(edges: DataFrame, nodes: DataFrame, n: int, kind: str = "unnormalized", eps: float = 1e-8, rounds: int = 60, dense_nodes: int = DENSE_NODES) -> tuple[DataFrame, np.ndarray]:
    """(id, z array<double>, scale) and the eigenvalues: the n smallest pairs, without the constant one if its value is 0.

    The sign of a vector makes its largest component positive. "random" divides vectors by the scale.
    """
    off, diag = laplacian(edges, nodes, kind)
    off, diag = stage(off, "laplacian"), stage(diag, "diagonal")
    count = diag.count()
    if count == 0:
        raise ValueError("the graph has no nodes")
    want = min(n + 1, count)
    solved = None
    if dense_nodes < count <= LEVEL_NODES and off.count() <= LEVEL_ENTRIES:
        d, o = diag.orderBy("i").toArrow(), off.toArrow()
        ids = d["i"].to_numpy()
        solved = _by_levels(d["diag"].to_numpy(), np.searchsorted(ids, o["i"].to_numpy()), np.searchsorted(ids, o["j"].to_numpy()), o["v"].to_numpy(), want)
    if solved:
        values, vectors = solved
        x = pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), len(values)).cast(pa.list_(pa.float64()))
        z = stage(edges.sparkSession.createDataFrame(pa.table({"i": d["i"].combine_chunks(), "x": x, "scale": d["scale"].combine_chunks()})), "vectors")
    elif count <= dense_nodes:
        d, o = diag.toPandas().sort_values("i", ignore_index=True), off.toPandas()
        at = {v: k for k, v in enumerate(d["i"])}
        a = np.diag(d["diag"].to_numpy())
        np.add.at(a, (o["i"].map(at).to_numpy(int), o["j"].map(at).to_numpy(int)), o["v"].to_numpy())
        values, vectors = np.linalg.eigh(a)
        values, vectors = values[:want], vectors[:, :want]
        rows = [(int(i), [float(x) for x in v], float(s)) for i, v, s in zip(d["i"], vectors, d["scale"])]
        z = edges.sparkSession.createDataFrame(rows, "i long, x array<double>, scale double")
    else:
        k = min(count, want + 4)
        top = float(off.groupBy("i").agg(F.sum(F.abs("v")).alias("r")).join(diag, "i").agg(F.max(F.col("diag") + F.col("r"))).first()[0] or 1.0)
        draw = [((F.xxhash64(F.lit(c), "i") % 1_000_003) / 1_000_003.0).alias(f"c{c}") for c in range(k)]
        x = stage(diag.select("i", *draw).select("i", F.array(*[f"c{c}" for c in range(k)]).alias("x")), "block")
        values = np.zeros(k)
        cut, before = top * 0.5, None
        for _ in range(rounds):
            # a Chebyshev filter of degree 8 damps [cut, top] and lifts what lies below
            c, e = (top + cut) / 2, (top - cut) / 2
            prev, now = x, None
            for degree in range(8):
                lx = matvec(off, diag, x if now is None else now, k)
                base = x if now is None else now
                step = lx.join(base.select("i", F.col("x").alias("b")), "i")
                if now is None:
                    nxt = step.select("i", F.zip_with("x", "b", lambda p, q: (p - q * c) / e).alias("x"))
                else:
                    step = step.join(prev.select("i", F.col("x").alias("p")), "i")
                    nxt = step.select("i", F.zip_with(F.zip_with("x", "b", lambda p, q: (p - q * c) * (2 / e)), "p", lambda p, q: p - q).alias("x"))
                prev, now = base, stage(nxt, "filtered")
            u, s, _ = np.linalg.svd(_product(now, now, k))
            q = stage(_turn(now, u / np.sqrt(np.maximum(s, 1e-300))), "orthonormal")
            lq = matvec(off, diag, q, k)
            h = _product(q, lq, k)
            values, turn = np.linalg.eigh((h + h.T) / 2)
            x = stage(_turn(q, turn), "block")
            cut = min(top * 0.9, max(values[-1] * 1.05, top * 1e-3))
            if before is not None and np.abs(values[:want] - before[:want]).max() < eps * max(1.0, top):
                break
            before = values
        values = values[:want]
        z = x.join(diag.select("i", "scale"), "i").select("i", F.slice("x", 1, want).alias("x"), "scale")
    skip = 1 if abs(values[0]) < max(1e-8, 10 * eps) else 0
    values = values[skip : skip + n]
    z = z.select("i", F.slice("x", skip + 1, len(values)).alias("x"), "scale")
    if kind == "random":
        z = z.withColumn("x", F.transform("x", lambda v: v / F.col("scale")))
    k = len(values)
    big = z.agg(*[F.max(F.struct(F.abs(F.element_at("x", c + 1)).alias("a"), F.signum(F.element_at("x", c + 1)).alias("s"))).alias(f"m{c}") for c in range(k)]).first()
    signs = F.array(*[F.lit(float((big[f"m{c}"]["s"] or 1.0))) for c in range(k)])
    return z.select(F.col("i").alias("id"), F.zip_with("x", signs, lambda a, b: a * b).alias("z"), "scale"), values


def refine_codes(codes: DataFrame, edges: DataFrame, n: int, sweeps: int = 1000) -> DataFrame:
    """(id, bit, b): bits flipped while that lowers the cut: a node takes the sign of its neighbours' weighted sum.

    Nodes of equal colour by a keyed hash move together, in turns, so that no two ends of most edges move at once; a sweep
    that would not lower the energy of a bit ends it. ``codes`` is long form (id, bit, b).
    """
    s = stage(codes.select("id", "bit", (F.col("b") * 2 - 1).alias("s")), "spins")
    w = stage(symmetric(edges.select("src", "dst", "weight")), "weights")
    colours, idle = 8, 0
    for turn in range(sweeps):
        field = w.join(s.select(F.col("id").alias("dst"), "bit", "s"), "dst").groupBy(F.col("src").alias("id"), "bit").agg(F.sum(F.col("weight") * F.col("s")).alias("f"))
        mine = F.pmod(F.xxhash64("id"), F.lit(colours)) == turn % colours
        new = stage(s.join(field, ["id", "bit"], "left").select("id", "bit", F.when(mine & (F.coalesce("f", F.lit(0.0)) * F.col("s") < 0), -F.col("s")).otherwise(F.col("s")).alias("s"), (mine & (F.coalesce("f", F.lit(0.0)) * F.col("s") < 0)).cast("long").alias("moved")), "spins")
        moved = new.agg(F.sum("moved")).first()[0] or 0
        s, idle = new.drop("moved"), 0 if moved else idle + 1
        if idle >= colours:
            break
    return s.select("id", "bit", ((F.col("s") + 1) / 2).cast("int").alias("b"))
