"""MinHash near-duplicates by a containment ensemble.

Two texts are linked where at least ``containment`` of the smaller shingle set lies in the larger one, whatever their
sizes. Shingles are ``k`` words. Texts that are equal form a class; the smallest id stands for it.

Classes are partitioned by size of their sets, each partition's upper end ``step`` times its lower. In a pair of
partitions whose sizes can differ by the factor x, containment c means a Jaccard of c / (1 + x - c) at least, and each
pair of partitions has its own tuning for that threshold:

1. Sizes within ``near`` of each other: bands of two rows. The fewest bands are taken of which a pair at the threshold
   shares less than ``votes`` with probability ``miss``: fewer within a partition, more across two, all of them prefixes
   of one list. Buckets that have the same smallest member lie in one task, which counts a pair's buckets before
   anything is sent; a bucket above ``tile`` classes is cut into chunks by a hash, and each pair of chunks is a task of
   its own. Pairs that share ``votes`` buckets are verified exactly, by set intersection.
2. Sizes further apart: the threshold falls with x, to where two rows find nothing, so bands have one row. The minima are
   the ``bottom`` smallest hashes of the smaller text's shingles (all of its shingles, if it has ``whole`` at most), looked
   up among all shingles of larger texts. Of m such hashes a contained text shares ``need`` at least, so of the m + 1 - need
   rarest it shares one: only those are keys, and what many texts hold is no key unless nothing rarer is left. Under a key
   all smaller texts meet all larger ones in tiles; a pair counts under the first key it shares, so no pair is ever
   shuffled. For texts hashed whole that count is exact; pairs of others are verified by set intersection.

Links of the first kind give components, the groups of near-copies; of each one text is kept. Links of the second kind
are containment: a short text in many long ones would join all of them to one group, so they are counted and named, but
group nothing.

Results of each row: class_id (the group of near-copies it is in: smallest id reachable by links of the first kind),
copy_id (smallest id of equal text), n_copies (rows of equal text), n_links (links of that text to other texts, of both
kinds), n_containers and container_id (larger texts that hold it by links of the second kind: number, smallest copy_id),
component_id (the same as class_id), kept (doc_id = class_id).

Where only groups are asked for (:func:`groups`), links of the second kind are not looked for, and of the first kind only as
many are named as join a group: no table of pairs is written.

Nulls: a null text is a text of its own that links with nothing, as do empty texts and texts without a word, but equal
ones among those are copies if not null and not empty. A null id takes part in no link. Ids are taken to be unique;
repeated rows are copies of each other and all of them are ``kept`` if one is. Very long texts are compared whole. Ties:
the smaller id. Empty table: an empty result. Other columns are ignored, whatever their names. Ids must be whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitweave.llm.held import small_batches
from bitweave.llm.shingles import fingerprints, minhash, mix, narrow
from bitweave.llm.word_encoder import portions, ragged
from bitweave.operators.components import connected_components
from bitweave.session import Staging, stage, unshuffled

K, CONTAINMENT, NEAR, STEP, VOTES, MISS, TILE = 3, 0.6, 1.3, 1.14, 3, 1e-2, 256
#: A text of at most WHOLE shingles is hashed whole; of others BOTTOM hashes, NEED of which a contained text shares (0.98).
WHOLE, BOTTOM, NEED = 64, 16, 6
#: Smaller and larger texts of a tile; the most bits of the filter that larger texts' shingles pass.
SMALLER, LARGER, FILTER_BITS = 2048, 1024, 30
#: The most keys of a tile's smaller texts that are sent to a larger text to see whether it has enough of them.
UNION = 128
_BAND = 7  # low bits of a key that hold its band
PORTION = 1 << 19  # characters worked off at once
_LOW = (1 << 31) - 1
_NONE = np.zeros(0, "<u4")
_MET = pa.schema([("a", pa.int64()), ("home", pa.int64()), ("others", pa.list_(pa.int64())), ("votes", pa.list_(pa.int16()))])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("votes", pa.int32()), ("tile", pa.int64())])


def jaccard_at(containment: float, x: float) -> float:
    """The least Jaccard of a pair of that containment of the smaller set, sizes differing by the factor x."""
    return containment / (1 + x - containment)


def missed(p: float, n: int, votes: int) -> float:
    """Probability of less than ``votes`` successes of n."""
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(min(votes, n + 1)))


def bands_for(jaccard: float, miss: float, votes: int = VOTES, rows: int = 2) -> int:
    """The fewest bands of which a pair of that Jaccard shares ``votes`` with a probability of at least 1 - miss."""
    n = votes
    while missed(jaccard**rows, n, votes) > miss:
        n += 1
    if n > 1 << _BAND:
        raise ValueError(f"more than {1 << _BAND} bands")
    return n


def _texts(pdf: pd.DataFrame) -> list[str]:
    return [t if isinstance(t, str) else "" for t in pdf["t"]]


def _lists(flat: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    return np.split(flat, np.cumsum(n)[:-1]) if len(n) else []


def bottom_sketch(prints: np.ndarray, n: np.ndarray, whole: int, bottom: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of texts of at most ``whole``, of others those of the ``bottom`` smallest hashes; and their numbers."""
    doc = np.repeat(np.arange(len(n)), n)
    h = mix(prints + np.uint64(0x5851F42D4C957F2D))
    # four times as many as wanted are expected below this, so that few must be sorted
    limit = np.where(n <= max(whole, 8 * bottom), np.inf, 2.0**64 * 4 * bottom / np.maximum(n, 1))
    some = np.flatnonzero(h < limit[doc])
    some = some[np.lexsort((h[some], doc[some]))]
    count = np.bincount(doc[some], minlength=len(n))
    pos = np.arange(len(some)) - np.repeat(np.cumsum(count) - count, count)
    keep = some[(pos < bottom) | (n[doc[some]] <= whole)]
    return prints[keep], np.bincount(doc[keep], minlength=len(n))


def _sign(k: int, bands: int, whole: int, bottom: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        band = np.arange(bands, dtype=np.uint64)
        with np.errstate(over="ignore"):
            salt = mix(band + np.uint64(1))
        for pdf in batches:
            texts = _texts(pdf)
            for lo, hi in portions(texts, PORTION):
                prints, n = fingerprints(texts[lo:hi], k)
                m = minhash(*narrow(prints, n), bands * 2).astype(np.uint64)
                keys = mix((m[:, ::2] << np.uint64(32) | m[:, 1::2]) ^ salt)
                keys = (keys >> np.uint64(_BAND) << np.uint64(_BAND) | band).astype(np.int64)
                yield pd.DataFrame({"id": pdf["id"].iloc[lo:hi], "h": pdf["h"].iloc[lo:hi], "size": n, "keys": list(keys), "sketch": _lists(*(x.astype(np.int64) for x in bottom_sketch(prints, n, whole, bottom)))})

    return run


def _sets(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = _texts(pdf)
            for lo, hi in portions(texts, PORTION):
                sets, n = narrow(*fingerprints(texts[lo:hi], k))
                ends = np.cumsum(n) * 4
                flat = sets.astype("<u4").tobytes()
                yield pd.DataFrame({"id": pdf["id"].iloc[lo:hi], "set": [flat[a:b] for a, b in zip((ends - n * 4).tolist(), ends.tolist())]})

    return run


# ---- filters --------------------------------------------------------------------------------------------------------


def _only(rows: DataFrame, key: str, wanted: DataFrame, n: int, most: int = 24) -> DataFrame:
    """Rows that may have one of the n wanted keys, so that fewer are shuffled: by a broadcast bitmap of 16 places a key,
    2**most places (2**(most - 6) rows) at the most. A join must still settle which do."""
    bits = min(most, max(10, math.ceil(math.log2(16 * n + 1))))
    place = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    words = wanted.select(place.alias("_p")).groupBy(F.shiftright("_p", 6).alias("_w")).agg(F.expr("bit_or(shiftleft(1L, cast(_p % 64 as int)))").alias("_b"))
    marked = rows.withColumn("_p", place).withColumn("_w", F.shiftright("_p", 6)).join(F.broadcast(words), "_w")
    return marked.where("shiftright(_b, cast(_p % 64 as int)) & 1 = 1").drop("_p", "_w", "_b")


def filter_words(keys: DataFrame, n: int, most: int = FILTER_BITS, width: int = 48) -> tuple[int, np.ndarray]:
    """A Bloom filter of the n ``key`` of ``width`` bits: its bits, log2, and its words. Two places a key, 16 bits a key, bounded by
    2**most bits; beyond that more passes, at no loss."""
    bits = min(most, max(12, math.ceil(math.log2(16 * n + 1))))
    places = F.explode(F.array(F.col("key").bitwiseAND(F.lit((1 << bits) - 1)), F.shiftright("key", width - bits)))
    with unshuffled(keys.sparkSession):
        got = keys.select(places.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("b")).toArrow()
    words = np.zeros(1 << (bits - 6), np.int64)
    words[got["w"].to_numpy()] = got["b"].to_numpy()
    return bits, words.view(np.uint64)


def _passing(keys: np.ndarray, bits: int, words: np.ndarray, width: int = 48) -> np.ndarray:
    """Where keys pass the filter."""

    def there(p: np.ndarray) -> np.ndarray:
        return words[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1) == 1

    at = np.flatnonzero(there(keys & np.uint64((1 << bits) - 1)))
    return at[there(keys[at] >> np.uint64(width - bits))]


def _hits(k: int, bits: int, words):
    """(id, hits): of each text the shingles that pass the filter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = _texts(pdf)
            for lo, hi in portions(texts, PORTION):
                prints, n = fingerprints(texts[lo:hi], k)
                doc = np.repeat(np.arange(len(n)), n)
                at = _passing(prints, bits, words.value)
                yield pd.DataFrame({"id": pdf["id"].iloc[lo:hi], "hits": _lists(prints[at].astype(np.int64), np.bincount(doc[at], minlength=len(n)))})

    return run


def _narrowed(inner: tuple, heads: tuple):
    """(id, s, keys, first): of each text's hits those that pass either filter; keys by their low 31 bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = pdf["hits"].map(len).to_numpy()
            flat = np.concatenate(pdf["hits"].to_numpy()).astype(np.uint64) if len(pdf) else np.zeros(0, np.uint64)
            doc, out = np.repeat(np.arange(len(n)), n), []
            low = flat & np.uint64(_LOW)
            for keys, (bits, words), width, kept in ((low, inner, 31, np.int32), (flat, heads, 48, np.int64)):
                at = _passing(keys, bits, words.value, width)
                out.append(_lists(keys[at].astype(kept), np.bincount(doc[at], minlength=len(n))))
            got = pd.DataFrame({"id": pdf["id"], "s": pdf["s"], "keys": out[0], "first": out[1]})
            yield got[got["first"].map(len) > 0]

    return run


# ---- sizes near each other ------------------------------------------------------------------------------------------


def _meet(same: int, near: float, step: float, flush: int = 1 << 21):
    """Rows (home, key, side, r, s) sorted by home, key, r give (a, home, others, votes): each member's larger ones that it
    shares buckets of the home with, as steps in ascending order from a, and how many of them."""

    def pairs(pdf: pd.DataFrame) -> pa.RecordBatch:
        home, key, side, s = (pdf[c].to_numpy() for c in ("home", "key", "side", "s"))
        who, r = pd.factorize(pdf["r"].to_numpy(), sort=True)
        p = np.floor(np.log(s) / math.log(step) + 1e-9)
        few = (key & ((1 << _BAND) - 1)) < same
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (home[1:] != home[:-1])])
        length = np.diff(np.r_[first, len(key)])
        end = np.repeat(first + length, length)
        code = pd.factorize(home)[0].astype(np.int64)
        out, rows = [], np.arange(len(key))
        for d in range(1, int(length.max())):
            rows = rows[rows + d < end[rows]]
            j = rows + d
            ok = (side[rows] == -side[j]) & (np.maximum(s[rows], s[j]) <= near * np.minimum(s[rows], s[j])) & (few[rows] | (p[rows] != p[j]))
            i, j = rows[ok], j[ok]
            out.append((code[i] << 42) | (np.minimum(who[i], who[j]) << 21) | np.maximum(who[i], who[j]))
        got, votes = np.unique(np.concatenate(out), return_counts=True) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        homes = pd.unique(home)
        low = (1 << 21) - 1
        mixed = (got >> 21 & low) != (got & low)
        got, votes = got[mixed], votes[mixed]
        at, a, b = got >> 42, r[got >> 21 & low], r[got & low]
        lists = np.flatnonzero(np.r_[True, np.diff(got >> 21) != 0][: len(got)])  # where a member's list begins
        steps = np.diff(b, prepend=0)
        steps[lists] = b[lists] - a[lists]
        offsets = pa.array(np.r_[lists, len(got)].astype(np.int32))
        flat = [pa.array(steps, pa.int64()), pa.array(votes.astype(np.int16), pa.int16())]
        return pa.record_batch([pa.array(a[lists], pa.int64()), pa.array(homes[at[lists]], pa.int64()), *(pa.ListArray.from_arrays(offsets, x) for x in flat)], _MET)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        rows = 0
        for pdf in (x.to_pandas() for x in batches):
            while len(pdf):
                last = pdf["home"].iloc[-1]
                at = int(np.flatnonzero(np.r_[True, (pdf["home"] != last).to_numpy()])[-1])  # rows before the last home
                if held and held[-1]["home"].iloc[-1] != pdf["home"].iloc[0] and rows >= 20_000:
                    yield pairs(pd.concat(held))
                    held, rows = [], 0
                if rows + at >= 20_000 and at:
                    yield pairs(pd.concat([*held, pdf.iloc[:at]]))
                    held, rows, pdf = [], 0, pdf.iloc[at:]
                    continue
                held.append(pdf)
                rows += len(pdf)
                break
        if held:
            yield pairs(pd.concat(held))

    return run


def _counted(least: int, flush: int = 1 << 20):
    """Of the lists of :func:`_meet`, sorted by a, the pairs with ``least`` votes in all: (a, b, votes, tile), tile the home that has most of them."""

    def merged(rows: pa.Table) -> pd.DataFrame:
        a, home = (rows[c].to_numpy() for c in ("a", "home"))
        steps, votes = (rows[c].combine_chunks() for c in ("others", "votes"))
        n = steps.value_lengths().to_numpy()
        ends, steps = np.cumsum(n), steps.flatten().to_numpy()
        total = np.cumsum(steps)
        b = total - np.repeat(total[ends - n] - steps[ends - n], n) + np.repeat(a, n)
        a, home, votes = np.repeat(a, n), np.repeat(home, n), votes.flatten().to_numpy().astype(np.int64)
        order = np.lexsort((home, votes, b, a))
        a, b, home, votes = a[order], b[order], home[order], votes[order]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        got = pd.DataFrame({"a": a[first], "b": b[first], "votes": np.add.reduceat(votes, first).astype(np.int32), "tile": home[np.r_[first[1:], len(a)] - 1]})
        return got[got["votes"] >= least]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        pairs = 0
        for batch in batches:
            if not len(batch):
                continue
            ids = batch["a"].to_numpy()
            at = int(np.searchsorted(ids, ids[-1]))  # rows before the last a
            if not at and held and held[-1]["a"][-1].as_py() != ids[0]:
                at = -1
            if pairs >= flush and at:
                whole = pa.Table.from_batches([*held, *([batch.slice(0, at)] if at > 0 else [])])
                yield from pa.Table.from_pandas(merged(whole), _PAIRS, preserve_index=False).to_batches()
                batch, held, pairs = batch.slice(max(at, 0)), [], 0
            held.append(batch)
            pairs += len(batch["others"].flatten())
        if held:
            yield from pa.Table.from_pandas(merged(pa.Table.from_batches(held)), _PAIRS, preserve_index=False).to_batches()

    return run


def candidates(classes: DataFrame, same: int, near: float = NEAR, step: float = STEP, votes: int = VOTES, tile: int = TILE) -> DataFrame:
    """(a, b, votes, tile), a < b: pairs of classes (rep, size, keys) whose sizes are within ``near`` and that share at
    least ``votes`` buckets, how many they share, and a tile that holds both: the home in which they share most."""
    rows = classes.where("size > 0").select(F.col("rep").alias("r"), F.col("size").cast("int").alias("s"), F.explode("keys").alias("key"))
    # a hot key is counted before this shuffle and its join may be split
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("hub")).where("n > 1")
    parts = F.when(F.col("n") <= tile, 1).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") / tile)))).cast("int")
    met = rows.join(buckets, "key").withColumn("parts", parts).withColumn("chunk", F.pmod(F.hash("r"), F.col("parts")))
    # a chunk meets itself (side 0) and every other
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    home = F.xxhash64("hub", "parts", F.least("chunk", "other"), F.greatest("chunk", "other"))
    met = met.select(home.alias("home"), "key", F.signum(F.col("other") - F.col("chunk")).cast("int").alias("side"), "r", "s")
    found = met.repartition("home").sortWithinPartitions("home", "key", "r").mapInArrow(_meet(same, near, step), "a long, home long, others array<long>, votes array<short>")
    # a pair meets in many homes: lists of steps take few bytes a pair, rows of pairs many
    return found.repartition("a").sortWithinPartitions("a").mapInArrow(_counted(votes), "a long, b long, votes int, tile long")


def _settle(edges: list[tuple[int, int]]) -> dict[int, int]:
    """The smallest id of each node's component."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def _compare(containment: float, pairs: bool):
    """Streams rows sorted by tile, its sets first, then its pairs: holds the sets of one tile. Gives the pairs that hold,
    or of each class in a tile its links there and the smallest class of its component there."""

    def links(found: list[tuple[int, int]]) -> tuple[list[int], list[int], list[int]]:
        root, n = _settle(found), {}
        for a, b in found:
            n[a] = n.get(a, 0) + 1
            n[b] = n.get(b, 0) + 1
        return list(n), list(n.values()), [root[x] for x in n]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sets, found = None, {}, []
        for pdf in batches:
            out: list[tuple] = []
            for tile, role, a, b, s in zip(pdf["tile"], pdf["role"], pdf["a"], pdf["b"], pdf["set"]):
                if tile != now:
                    if found and not pairs:
                        out += zip(*links(found))
                        found = []
                    now, sets = tile, {}
                if role == 0:
                    sets[a] = np.frombuffer(s, "<u4")
                    continue
                small, large = sorted((sets.get(a, _NONE), sets.get(b, _NONE)), key=len)
                if not len(small):
                    continue
                at = large.searchsorted(small)
                at[at == len(large)] = 0
                if np.count_nonzero(large[at] == small) >= containment * len(small):
                    found.append((a, b))
            if pairs:
                out, found = found, []
            yield pd.DataFrame(out, columns=["a", "b"] if pairs else ["rep", "links", "root"]).astype("int64")
        if found:
            yield pd.DataFrame(list(zip(*links(found))), columns=["rep", "links", "root"])

    return run


def verify(pairs: DataFrame, sets: DataFrame, containment: float, group: int = 512, counted: bool = False) -> DataFrame:
    """Of pairs (a, b) those that hold, from (id, set); or, ``counted``, (rep, links, root) of each class and tile.

    A set is sent once to each tile of pairs that needs it; without a column ``tile`` the pairs of each a are one, or
    parts of about ``group`` of them."""
    if "tile" not in pairs.columns:
        heads = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("parts"))
        pairs = pairs.join(heads, "a").withColumn("tile", F.xxhash64("a", F.pmod(F.hash("b"), F.col("parts"))))
    members = pairs.select("tile", F.col("a").alias("id")).unionByName(pairs.select("tile", F.col("b").alias("id"))).distinct()
    held = members.join(sets.hint("merge"), "id").select("tile", F.lit(0).alias("role"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), "set")
    asked = pairs.select("tile", F.lit(1).alias("role"), "a", "b", F.lit(None).cast("binary").alias("set"))
    kind = "rep long, links long, root long" if counted else "a long, b long"
    return held.unionByName(asked).repartition("tile").sortWithinPartitions("tile", "role").mapInPandas(_compare(containment, not counted), kind)


# ---- sizes far apart ------------------------------------------------------------------------------------------------


def _inside(near: float, whole: int, block: int = 256):
    """Streams rows sorted by tile: smaller texts (side 0) with their keys, rarest first, and larger ones (side 1) with
    theirs. Gives (rep, links, containers, container) of exact links and (a, b, tile) of pairs that must be verified."""

    def matrix(rows: list[tuple], every: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Which of the keys ``every`` each row has (of its first ``before`` ones)."""
        keys, n = np.concatenate([x[4] for x in rows]), np.array([len(x[4]) for x in rows])
        at = np.searchsorted(every, keys)
        at[at == len(every)] = 0
        hit = every[at] == keys
        if before is not None:
            hit &= ragged(np.zeros(len(n), np.int64), n) < np.repeat(before, n)
        out = np.zeros((len(rows), len(every)), np.float32)
        out[np.repeat(np.arange(len(rows)), n)[hit], at[hit]] = 1
        return out

    def tile(name: int, small: list[tuple], large: list[tuple], out: list[tuple]) -> None:
        keys = np.unique(np.concatenate([x[4] for x in small]))
        keys = np.intersect1d(keys, np.concatenate([x[4] for x in large]))  # what no larger text has counts for none
        links = np.zeros(len(large), np.int64)
        sb, ids = np.array([x[1] for x in large]), np.array([x[0] for x in large])
        for i in range(0, len(small), block):
            a = small[i : i + block]
            sa, pos, need = (np.array([x[c] for x in a]) for c in (1, 2, 3))
            have, early = matrix(a, keys), matrix(a, keys, pos)
            own, container = np.zeros(len(a), np.int64), np.full(len(a), np.iinfo(np.int64).max)
            for j in range(0, len(large), block):
                to = slice(j, j + block)
                b = matrix(large[to], keys).T
                ok = (have @ b >= need[:, None]) & (early @ b == 0) & (sb[None, to] > near * sa[:, None])
                exact = ok & (sa <= whole)[:, None]
                links[to] += exact.sum(0)
                own += exact.sum(1)
                container = np.minimum(container, np.where(exact, ids[None, to], np.iinfo(np.int64).max).min(1))
                for x, y in np.argwhere(ok & ~exact).tolist():
                    out.append((None, None, None, None, a[x][0], int(ids[j + y]), name))
            for x in np.flatnonzero(own).tolist():
                out.append((a[x][0], int(own[x]), int(own[x]), int(container[x]), None, None, None))
        for y in np.flatnonzero(links).tolist():
            out.append((int(ids[y]), int(links[y]), 0, None, None, None, None))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, small, large = None, [], []
        cols = ["rep", "links", "containers", "container", "a", "b", "tile"]
        for pdf in batches:
            out: list[tuple] = []
            for t, side, r, s, pos, need, keys in zip(*(pdf[c] for c in ("tile", "side", "r", "s", "pos", "need", "keys"))):
                if t != now:
                    if small and large:
                        tile(now, small, large, out)
                    now, small, large = t, [], []
                (large if side else small).append((r, s, pos, need, keys))
            yield pd.DataFrame(out, columns=cols).astype("Int64")
        out = []
        if small and large:
            tile(now, small, large, out)
        yield pd.DataFrame(out, columns=cols).astype("Int64")

    return run


def contained(d: DataFrame, classes: DataFrame, k: int, containment: float, near: float, whole: int, bottom: int, need: int, smaller: int = SMALLER, larger: int = LARGER, most: int = FILTER_BITS, union: int = UNION) -> DataFrame:
    """(rep, links, containers, container), or (a, b, tile) still to be verified, of pairs whose sizes differ by more than the factor ``near``."""
    spark = d.sparkSession
    with Staging(spark) as own:
        found = _contained(d, classes, k, containment, near, whole, bottom, need, smaller, larger, most, union)
    found = stage(found, "inside")
    own.sweep(found)
    return found


def _contained(d: DataFrame, classes: DataFrame, k: int, containment: float, near: float, whole: int, bottom: int, need: int, smaller: int, larger: int, most: int, union: int) -> DataFrame:
    spark = d.sparkSession
    own = classes.where("size > 0").select(F.col("rep").alias("r"), F.col("size").cast("int").alias("s"), "sketch")
    keys = own.select("r", "s", F.explode("sketch").alias("key"))
    n = own.agg(F.sum(F.size("sketch"))).first()[0] or 0
    bits, words = filter_words(keys, n, most)
    held = spark.sparkContext.broadcast(words)
    hits = d.select("id", "t").mapInPandas(_hits(k, bits, held), "id long, hits array<long>")
    hits = stage(hits.join(own.select(F.col("r").alias("id"), "s").hint("merge"), "id"), "hits")
    df = hits.select(F.explode("hits").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # of each text its shared keys, rarest first; those that no other text has come before all of them
    shared = keys.join(df, "key").groupBy("r", "s").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("ks"))
    least = F.when(F.col("s") <= whole, F.ceil(F.col("s") * containment - 1e-9)).otherwise(need).cast("int")
    first = shared.withColumn("need", least).withColumn("take", F.size("ks") - F.col("need") + 1).where("take > 0")
    a = stage(first.select("r", "s", "need", F.posexplode(F.slice("ks", F.lit(1), F.col("take"))).alias("pos", "x"), F.transform("ks", lambda x: x["key"].bitwiseAND(F.lit(_LOW)).cast("int")).alias("keys")).select("r", "s", "need", "pos", F.col("x.key").alias("key"), F.col("x.n").alias("n"), "keys"), "inner")
    # what the smaller texts of a key have in all, where that is short, and the least that one of them needs
    na, nb = F.ceil(F.count(F.lit(1)) / smaller).cast("int"), F.ceil(F.first("n") / larger).cast("int")
    counts = a.groupBy("key").agg(F.min("s").alias("least"), F.min("need").alias("fewest"), na.alias("na"), nb.alias("nb"), F.sum(F.size("keys")).alias("held"))
    short = a.join(counts.where(F.col("held") <= union).select("key"), "key").groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("every"))
    plan = stage(counts.drop("held").join(short, "key", "left"), "keys")
    wanted = plan.select("key")
    cell = lambda x, y: F.xxhash64("key", x, y)
    none = F.lit(0).alias
    # larger texts go along with the keys that smaller ones have, no others
    inner = a.select(F.explode(F.col("keys").cast("array<long>")).alias("key")).distinct()
    filters = []
    for ks, width in ((inner, 31), (wanted, 48)):
        with unshuffled(spark):
            n = ks.count()
        bits, words = filter_words(ks, n, min(most, width), width)
        filters.append((bits, spark.sparkContext.broadcast(words)))
    b = stage(hits.mapInPandas(_narrowed(*filters), "id long, s int, keys array<int>, first array<long>"), "outer")
    # which tiles a text goes to is found without its keys; then it goes along with those of the tile, and only if they suffice
    slim = b.where(F.size("keys") > 0).select(F.col("id").alias("r"), "s", F.size("keys").alias("has"), F.explode("first").alias("key")).join(plan.select("key", "least", "fewest", "every", "na", "nb"), "key")
    slim = slim.where((F.col("s") > F.lit(near) * F.col("least")) & (F.col("has") >= F.col("fewest"))).select("r", "key", "fewest", "every", "na", "nb")
    fitting = slim.join(b.select(F.col("id").alias("r"), "s", "keys").hint("merge"), "r").withColumn("keys", F.when(F.col("every").isNull(), F.col("keys")).otherwise(F.array_intersect("keys", "every")))
    fitting = stage(fitting.where(F.size("keys") >= F.col("fewest")).select("key", "r", "s", "keys", "na", "nb"), "larger")
    right = fitting.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).select(cell(F.col("j"), F.pmod(F.hash("r"), F.col("nb"))).alias("tile"), F.lit(1).alias("side"), "r", "s", none("pos"), none("need"), "keys")
    # smaller texts go where larger ones do
    left = a.join(fitting.select("key", "na", "nb").distinct(), "key").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    left = left.select(cell(F.pmod(F.hash("r"), F.col("na")), F.col("j")).alias("tile"), none("side"), "r", "s", "pos", "need", "keys")
    rows = left.unionByName(right).repartition("tile").sortWithinPartitions("tile", "side")
    return rows.mapInPandas(_inside(near, whole), "rep long, links long, containers long, container long, a long, b long, tile long")


# ---- groups without their pairs -------------------------------------------------------------------------------------


def _joining(containment: float, near: float, step: float, same: int, bands: int, votes: int, room: int = 1 << 24, block: int = 1 << 20):
    """Streams rows sorted by home: members (side: 1, 2 or both, which meet the other side) with their label, keys, those of
    most texts first, and set. Gives pairs (a, b) that hold, only such as join two labels that weren't joined here before."""

    def pairs(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of places within each run."""
        left = np.repeat(length, length) - 1 - ragged(np.zeros(len(length), np.int64), length)
        at = ragged(start, length)
        return np.repeat(at, left), ragged(at + 1, left)

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        r, s, side = (pdf[c].to_numpy() for c in ("r", "s", "side"))
        node, labels = pd.factorize(pdf["label"])
        home = pd.factorize(pdf["home"])[0]
        n = pdf["keys"].map(len).to_numpy()
        flat, who = np.concatenate(pdf["keys"].to_numpy()), np.repeat(np.arange(len(n)), n)
        table = np.zeros((len(n), bands), np.int64)
        table[who, flat & ((1 << _BAND) - 1)] = flat
        sets = [np.frombuffer(x, "<u4") for x in pdf["set"]]
        p = np.floor(np.log(s) / math.log(step) + 1e-9)
        parent, root, out = list(range(len(labels))), np.arange(len(labels)), []

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            v = np.zeros(len(a), np.int64)
            for lo in range(0, len(a), 1 << 14):
                x, y = a[lo : lo + (1 << 14)], b[lo : lo + (1 << 14)]
                eq = (table[x] == table[y]) & (table[x] != 0)
                v[lo : lo + (1 << 14)] = eq[:, :same].sum(1) + eq[:, same:].sum(1) * (p[x] != p[y])
            return v

        # a pair that shares ``votes`` keys shares one besides the votes - 1 of each that most texts have
        use = np.flatnonzero(ragged(np.zeros(len(n), np.int64), n) >= votes - 1)
        use = use[np.lexsort((flat[use], home[who[use]]))]
        member, key = who[use], flat[use]
        start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (home[member[1:]] != home[member[:-1]])][: len(key)])
        length = np.diff(np.r_[start, len(key)])
        order = np.argsort(length, kind="stable")
        start, length = (x[order][length[order] > 1] for x in (start, length))
        part = np.cumsum(length * (length - 1) // 2) // block
        for one in np.split(np.arange(len(start)), np.flatnonzero(np.diff(part)) + 1):
            if not len(one):
                continue
            of = np.repeat(np.arange(len(one)), length[one])
            own = root[node[member[ragged(start[one], length[one])]]]
            several = np.bincount(of, own != own[np.r_[0, np.cumsum(length[one])[:-1]]][of]) > 0
            i, j = pairs(start[one[several]], length[one[several]])
            a, b = member[i], member[j]
            ok = (root[node[a]] != root[node[b]]) & (side[a] | side[b] == 3) & (np.maximum(s[a], s[b]) <= near * np.minimum(s[a], s[b]))
            a, b = np.divmod(np.unique(np.minimum(a, b)[ok] * len(n) + np.maximum(a, b)[ok]), len(n))
            v = shared(a, b)
            best = np.argsort(-v, kind="stable")[: np.count_nonzero(v >= votes)]
            a, b = a[best], b[best]
            while len(a):
                for x, y in zip(a[:4096].tolist(), b[:4096].tolist()):
                    u, w = find(node[x]), find(node[y])
                    if u == w:
                        continue
                    small, large = sorted((sets[x], sets[y]), key=len)
                    at = large.searchsorted(small)
                    at[at == len(large)] = 0
                    if np.count_nonzero(large[at] == small) >= containment * len(small):
                        parent[w] = u
                        out.append((r[x], r[y]))
                root = np.array([find(x) for x in range(len(parent))])
                ok = root[node[a[4096:]]] != root[node[b[4096:]]]
                a, b = a[4096:][ok], b[4096:][ok]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for pdf in batches:
            if not len(pdf):
                continue
            at = int((pdf["home"] != pdf["home"].iloc[-1]).sum())  # rows before the last home
            if size >= room and (at or held[-1]["home"].iloc[-1] != pdf["home"].iloc[0]):
                yield settle(pd.concat([*held, pdf.iloc[:at]], ignore_index=True))
                held, size, pdf = [], 0, pdf.iloc[at:]
            held.append(pdf)
            size += int(pdf["set"].map(len).sum()) + 2000 * len(pdf)
        if held:
            yield settle(pd.concat(held, ignore_index=True))

    return run


def joining(classes: DataFrame, d: DataFrame, k: int, containment: float, same: int, bands: int, near: float = NEAR, step: float = STEP, votes: int = VOTES, tile: int = TILE) -> DataFrame:
    """(a, b) of links that join the groups in which all links of sizes within ``near`` would join the classes (rep, size, keys).

    The members of a home get together with their sets, so that no pair leaves it but one that joins two groups. A bucket
    above ``tile`` classes is first cut into chunks, each with the bucket's smallest member, that meet themselves only; then
    all whose group isn't the bucket's largest meet all of it, in tiles. A pair of one group has nothing to add to it."""
    rows = classes.where("size > 0").select(F.col("rep").alias("r"), F.col("size").cast("int").alias("s"), F.explode("keys").alias("key"))
    several = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ks = F.sort_array(F.collect_list(F.struct("n", "key")), asc=False)
    own = rows.join(several, "key").groupBy("r", "s").agg(ks.alias("ks")).where(F.size("ks") >= votes)
    own = stage(own.select("r", "s", F.transform("ks", lambda x: x["key"]).alias("keys")), "shared")
    chunks = lambda n: F.when(n <= tile, 1).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(n / tile)))).cast("int")
    found = own.select("r", F.explode(F.slice("keys", F.lit(votes), F.size("keys"))).alias("key"))
    buckets = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("hub")).where("n > 1")
    found = stage(found.join(buckets, "key").select("r", "key", "hub", chunks(F.col("n")).alias("parts")), "buckets")
    wanted = stage(found.select(F.col("r").alias("id")).distinct(), "wanted")
    sets = _only(d, "id", wanted, wanted.count()).join(wanted.hint("merge"), "id").mapInPandas(_sets(k), "id long, set binary")
    members = stage(own.join(sets.withColumnRenamed("id", "r").hint("merge"), "r"), "members")

    def meet(places: DataFrame) -> DataFrame:
        at = places.distinct().join(members.hint("merge"), "r").select("home", "side", "r", "label", "s", "keys", "set")
        return at.repartition("home").sortWithinPartitions("home").mapInPandas(_joining(containment, near, step, same, bands, votes), "a long, b long")

    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    chunk = lambda n: F.pmod(F.hash("r"), F.col(n))
    both = F.lit(3).alias("side")
    places = found.select(F.xxhash64("hub", "parts", chunk("parts")).alias("home"), both, "r", F.col("r").alias("label"))
    hubs = found.where("parts > 1").select("hub", "parts").distinct().withColumn("i", span("parts"))
    links = stage(meet(places.unionByName(hubs.select(F.xxhash64("hub", "parts", "i").alias("home"), both, F.col("hub").alias("r"), F.col("hub").alias("label")))), "links")
    large = found.where("parts > 1")
    if large.isEmpty():
        return links
    label = F.coalesce("component", "r").alias("label")
    large = stage(large.join(connected_components(links, "a", "b").withColumnRenamed("id", "r"), "r", "left").select("r", "key", "hub", "parts", label), "large")
    most = F.max(F.struct("m", "label"))
    by = large.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(most["label"].alias("most"), (F.sum("m") - most["m"]).alias("rest")).where("rest > 0")
    large = large.join(by.select("key", "most", chunks(F.col("rest")).alias("others")), "key")
    home = lambda i, j: F.xxhash64("hub", "parts", "others", i, j).alias("home")
    one = large.withColumn("j", span("others")).select(home(chunk("parts"), F.col("j")), F.lit(1).alias("side"), "r", "label")
    other = large.where("label <> most").withColumn("i", span("parts")).select(home(F.col("i"), chunk("others")), F.lit(2).alias("side"), "r", "label")
    return links.unionByName(stage(meet(one.unionByName(other)), "links"))


# ---- all of it ------------------------------------------------------------------------------------------------------


def _rows(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, Column]:
    """(id, t) of each row, and what texts that are equal have in common."""
    d = small_batches(docs).select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    alone = F.col("id").isNull() | F.col("t").isNull() | (F.col("t") == "")
    # a text that is null or empty has no equals: its class is its own id
    return d, F.when(alone, F.concat(F.lit("-"), F.coalesce(F.col("id").cast("string"), F.lit("null"))).cast("binary")).otherwise(F.unhex(F.md5(F.col("t").cast("binary"))))


def groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, containment: float = CONTAINMENT, near: float = NEAR, step: float = STEP, votes: int = VOTES, miss: float = MISS, tile: int = TILE
) -> DataFrame:
    """doc_id, class_id and kept of each row, as :func:`near_duplicates` has them, without links and containers."""
    same = bands_for(jaccard_at(containment, min(step, near)), miss, votes)
    across = max(same, bands_for(jaccard_at(containment, near), miss, votes))
    d, h = _rows(docs, key, text)
    signed = d.select("id", h.alias("h"), F.when(F.col("id").isNotNull(), F.col("t")).alias("t")).mapInPandas(_sign(k, across, 0, 0), "id long, h binary, size long, keys array<long>, sketch array<long>")
    grouped = signed.groupBy("h").agg(F.min(F.struct("id", "size", "keys")).alias("one"))
    classes = stage(grouped.select("h", F.col("one.id").alias("rep"), "one.size", "one.keys"), "classes")
    links = joining(classes.where(F.col("rep").isNotNull()), d, k, containment, same, across, near, step, votes, tile)
    comps = connected_components(links, "a", "b")
    about = classes.select("h", "rep").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    group = F.coalesce("component", "rep")
    return d.select("id", h.alias("h")).join(about, "h").select(F.col("id").alias(key), group.alias("class_id"), F.coalesce(F.col("id") == group, F.lit(True)).alias("kept"))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, containment: float = CONTAINMENT, near: float = NEAR, step: float = STEP, votes: int = VOTES, miss: float = MISS, whole: int = WHOLE, bottom: int = BOTTOM, need: int = NEED, tile: int = TILE
) -> DataFrame:
    """doc_id, class_id, copy_id, n_copies, n_links, n_containers, container_id, component_id, kept of each row."""
    same = bands_for(jaccard_at(containment, min(step, near)), miss, votes)
    across = max(same, bands_for(jaccard_at(containment, near), miss, votes))
    d, h = _rows(docs, key, text)
    signed = d.select("id", h.alias("h"), F.when(F.col("id").isNotNull(), F.col("t")).alias("t")).mapInPandas(_sign(k, across, whole, bottom), "id long, h binary, size long, keys array<long>, sketch array<long>")
    grouped = signed.groupBy("h").agg(F.count(F.lit(1)).alias("n_copies"), F.min(F.struct("id", "size", "keys", "sketch")).alias("one"))
    classes = stage(grouped.select("h", "n_copies", F.col("one.id").alias("rep"), "one.size", "one.keys", "one.sketch"), "classes")
    reps = classes.where(F.col("rep").isNotNull())

    pairs = stage(candidates(reps, same, near, step, votes, tile), "candidates")
    far = contained(d, reps, k, containment, near, whole, bottom, need)
    unsure = far.where("a is not null").select("a", "b", "tile")
    ends = pairs.select("a", "b").unionByName(unsure.select("a", "b")).select(F.explode(F.array("a", "b")).alias("id"))
    wanted = stage(ends.distinct(), "wanted")
    sets = stage(_only(d, "id", wanted, wanted.count()).join(wanted.hint("merge"), "id").mapInPandas(_sets(k), "id long, set binary"), "sets")
    links = stage(verify(pairs, sets, containment, counted=True), "links")
    comps = connected_components(links.where("rep <> root"), "rep", "root")
    held = verify(unsure, sets, containment)
    null = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    each = links.select("rep", "links", zero.alias("containers"), null.alias("container"))
    each = each.unionByName(far.where("rep is not null").select("rep", "links", "containers", "container"))
    one = F.lit(1).cast("long")
    both = F.explode(F.array(F.struct(F.col("a").alias("rep"), one.alias("links"), one.alias("containers"), F.col("b").alias("container")), F.struct(F.col("b").alias("rep"), one.alias("links"), zero.alias("containers"), null.alias("container"))))
    each = each.unionByName(held.select(both.alias("x")).select("x.*"))
    degree = each.groupBy("rep").agg(F.sum("links").alias("n_links"), F.sum("containers").alias("n_containers"), F.min("container").alias("container_id"))
    about = classes.select("h", "rep", "n_copies").join(degree, "rep", "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    out = d.select("id", h.alias("h")).join(about, "h")
    return out.select(
        F.col("id").alias(key),
        F.coalesce("component", "rep").alias("class_id"),
        F.col("rep").alias("copy_id"),
        "n_copies",
        F.coalesce("n_links", zero).alias("n_links"),
        F.coalesce("n_containers", zero).alias("n_containers"),
        "container_id",
        F.coalesce("component", "rep").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "rep"), F.lit(True)).alias("kept"),
    )
