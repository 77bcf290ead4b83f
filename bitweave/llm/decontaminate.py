"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are normalised byte by byte (ASCII letters to lower case; blanks, punctuation and other ASCII marks become one
blank). Each benchmark item is cut into windows of ``window`` bytes, ``step`` apart, the last one at its end; an item
shorter than that is one window. A document is contaminated where a part of it is within ``edits`` of a window, edits
being ``rate`` of the window's length.

Two texts within k edits share at least m + 1 - q (k + 1) of the q-grams of the one of length m, all on diagonals within
k of each other. So shared q-grams are counted in overlapping bands of diagonals, 2 (k + 1) wide and k + 1 apart, and
bands that meet that bound are kept. Those regions are aligned: the fewest edits of the window against any part of the
region, by dynamic programming over a band of diagonals, all regions of a batch at once.

Documents are read as a stream; the benchmark's q-grams are held by each task, ``block_bytes`` of items at a time. A
larger benchmark is worked off in such blocks, each of them against all documents, so what is held never grows.

Nulls: null or empty documents and items match nothing; rows of a null id are documents like others. Items shorter than
``min_item`` normalised bytes are no evidence and match nothing. Ties and repeated rows: a row each; of equally good
items the smallest id is named. Empty tables: nothing is contaminated. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitweave.llm.held import held, small_batches
from bitweave.llm.language_id import slices

Q, WINDOW, STEP, RATE, MIN_ITEM, BLOCK_BYTES = 8, 64, 32, 0.05, 32, 4 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)]] = 32


def normalise(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' normalised bytes, each with a leading 0, and where each begins (behind its 0), with the end added."""
    raw = np.frombuffer(b"\x00" + b"\x00".join(texts) + b"\x00", np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.cumsum(size + 1) - size
    folded = _FOLD[raw]
    folded[np.r_[start - 1, len(raw) - 1]] = 0
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 32) | ((folded[:-1] != 32) & (folded[:-1] != 0))
    moved = np.cumsum(keep)
    return folded[keep], np.r_[moved[start - 1], len(folded[keep])].astype(np.int64)


def grams(buf: np.ndarray, q: int = Q) -> np.ndarray:
    """Each place's q bytes as a number; q is 8."""
    a = buf.astype(np.uint64)
    a = a[:-1] | a[1:] << np.uint64(8)
    a = a[:-2] | a[2:] << np.uint64(16)
    return a[:-4] | a[4:] << np.uint64(32)


class Index:
    """The windows of a block of items and where each q-gram lies in them."""

    def __init__(self, items: list[tuple[int, str]], window: int, step: int, rate: float, min_item: int):
        buf, start = normalise([t.encode() for _, t in items])
        self.rate = rate
        at, size, item = [], [], []
        for k, (i, _) in enumerate(items):
            a, b = int(start[k]), int(start[k + 1]) - 1
            while b > a and buf[b - 1] == 32:
                b -= 1
            if b - a < min_item:
                continue
            own = [*range(a, max(a + 1, b - window), step)]
            if b - a > window and own[-1] != b - window:
                own.append(b - window)
            if b - a <= window:
                own = [a]
            at += own
            size += [min(window, b - a)] * len(own)
            item += [i] * len(own)
        self.buf = buf
        self.at, self.size, self.item = np.array(at, np.int64), np.array(size, np.int64), np.array(item, np.int64)
        self.edits = np.floor(self.size * rate).astype(np.int64)
        self.need = np.maximum(1, self.size + 1 - Q * (self.edits + 1))
        g = grams(buf) if len(buf) >= Q else np.zeros(0, np.uint64)
        n = np.maximum(0, self.size - Q + 1)
        where = np.arange(int(n.sum())) + np.repeat(self.at - (np.cumsum(n) - n), n)
        all_grams, win = g[where], np.repeat(np.arange(len(n)), n)
        order = np.argsort(all_grams, kind="stable")
        self.win, self.off = win[order], (where - np.repeat(self.at, n))[order]
        self.gram, self.first = np.unique(all_grams[order], return_index=True)
        self.count = np.diff(np.r_[self.first, len(order)])
        self.bits = 22
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self._slot(self.gram)] = True

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def matches(self, texts: list[bytes]) -> pd.DataFrame:
        """doc (index), item, window, place, edits of each window found; the best place of a document and window."""
        empty = pd.DataFrame({"doc": [], "item": [], "edits": []}).astype("int64")
        if not len(self.gram) or not texts:
            return empty
        buf, start = normalise(texts)
        if len(buf) < Q:
            return empty
        g = grams(buf)
        near = np.flatnonzero(self.seen[self._slot(g)])
        k = np.searchsorted(self.gram, g[near])
        k[k == len(self.gram)] = 0
        true = self.gram[k] == g[near]
        near, k = near[true], k[true]
        if not len(near):
            return empty
        # A window needs many hits close together: drop hits in stretches that can't hold the fewest any window needs.
        least = int(self.need.min())
        reach = int((self.size + self.edits).max())
        dense = np.zeros(len(near), bool)
        if len(near) >= least:
            ok = near[least - 1 :] - near[: len(near) - least + 1] <= reach
            mark = np.zeros(len(near) + 1, np.int64)
            i = np.flatnonzero(ok)
            np.add.at(mark, i, 1)
            np.add.at(mark, i + least, -1)
            dense = np.cumsum(mark)[:-1] > 0
        near, k = near[dense], k[dense]
        if not len(near):
            return empty
        found = []
        c = self.count[k]
        cuts = np.r_[0, np.flatnonzero(np.diff(np.cumsum(c) // (4 << 20))) + 1, len(c)]
        # a cut must not part the hits of one document
        owner = np.searchsorted(start, near, side="right") - 1
        cuts = np.unique([0, *[int(np.searchsorted(owner, owner[x], side="left")) for x in cuts[1:-1]], len(c)])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            n = c[lo:hi]
            row = np.arange(int(n.sum())) + np.repeat(self.first[k[lo:hi]] - (np.cumsum(n) - n), n)
            win, place, doc = self.win[row], np.repeat(near[lo:hi], n), np.repeat(owner[lo:hi], n)
            diagonal = place - self.off[row]  # where the window would begin, without edits
            width = self.edits[win] + 1
            band = diagonal // width
            for shift in (0, 1):  # each diagonal lies in two bands, 2 * width wide
                key = np.stack([doc, win, band - shift])
                order = np.lexsort(key[::-1])
                kk = key[:, order]
                new = np.r_[True, (kk[:, 1:] != kk[:, :-1]).any(0)]
                # bands [b, b + 1]: count hits of both halves by merging the shifted keys
                if shift == 0:
                    base = kk[:, new], np.diff(np.r_[np.flatnonzero(new), len(order)])
                else:
                    other = kk[:, new], np.diff(np.r_[np.flatnonzero(new), len(order)])
            keys = np.concatenate([base[0], other[0]], 1)
            hits = np.concatenate([base[1], other[1]])
            order = np.lexsort(keys[::-1])
            keys, hits = keys[:, order], hits[order]
            new = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)])
            total = np.add.reduceat(hits, new)
            doc, win, band = keys[:, new]
            # repeated q-grams count once a pair of places, which can only keep more; the bound is never missed
            ok = total >= self.need[win]
            if ok.any():
                found.append(np.stack([doc[ok], win[ok], band[ok] * (self.edits[win[ok]] + 1)]))
        if not found:
            return empty
        doc, win, low = np.concatenate(found, 1)
        edits = self._align(buf, start, doc, win, low)
        ok = edits <= self.edits[win]
        out = pd.DataFrame({"doc": doc[ok], "item": self.item[win[ok]], "edits": edits[ok]})
        return out.groupby(["doc", "item"], as_index=False)["edits"].min()

    def _align(self, buf: np.ndarray, start: np.ndarray, doc: np.ndarray, win: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Fewest edits of each window against a part of the document whose diagonals lie in the band, or a large number.

        Lane d of row j is the window's first j bytes against text that ends at low - k + d + j. All regions step together.
        """
        out = np.full(len(doc), 1 << 20)
        for k in np.unique(self.edits[win]):
            rows = np.flatnonzero(self.edits[win] == k)
            for lo in range(0, len(rows), 8192):
                r = rows[lo : lo + 8192]
                lanes = 2 * (k + 1) + 2 * k + 1
                base = low[r] - k
                m = self.size[win[r]]
                a, b = start[doc[r]], start[doc[r] + 1] - 1  # the document's own bytes
                pad = np.int64(len(buf))
                d = np.arange(lanes)
                cost = np.zeros((len(r), lanes), np.int32)
                best = np.full(len(r), 1 << 20, np.int64)
                for j in range(int(m.max())):
                    p = base[:, None] + d + j
                    inside = (p >= a[:, None]) & (p < b[:, None])
                    t = np.where(inside, buf[np.clip(p, 0, pad - 1)], 0)
                    c = self.buf[self.at[win[r]] + np.minimum(j, m - 1)]
                    nxt = cost + (t != c[:, None])
                    nxt[:, :-1] = np.minimum(nxt[:, :-1], cost[:, 1:] + 1)  # a byte of the window without one in the text
                    # a byte of the text without one in the window: a running minimum along the lanes
                    nxt = np.minimum.accumulate(nxt - d, 1) + d
                    on = j < m
                    cost = np.where(on[:, None], nxt, cost)
                out[r] = cost.min(1)
        return out


def item_blocks(bench: DataFrame, item: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> list[list[tuple[int, str]]]:
    """The benchmark in blocks of bounded size, in order of id; one block at a time is read."""
    rows = bench.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).cast("long").alias("i"), F.col(text).alias("t")).distinct()
    blocks: list[list[tuple[int, str]]] = [[]]
    size = 0
    for r in rows.orderBy("i", "t").toLocalIterator():
        if size > block_bytes:
            blocks.append([])
            size = 0
        blocks[-1].append((r.i, r.t))
        size += len(r.t)
    return [b for b in blocks if b]


def _scan(block: list[tuple[int, str]], params: tuple, last: bool):
    key = ("items", tuple(block), params)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = held(key, lambda: Index(list(key[1]), *params))
        for pdf in batches:
            texts = [t.encode() if isinstance(t, str) else b"" for t in pdf["t"]]
            lo = size = 0
            for hi in range(1, len(texts) + 1):
                size += len(texts[hi - 1])
                if size < 1 << 20 and hi < len(texts):
                    continue
                m = index.matches(texts[lo:hi])
                items, best = [[] for _ in range(hi - lo)], [None] * (hi - lo)
                if "items" in pdf:  # what earlier blocks found
                    items, best = [list(x) for x in pdf["items"].iloc[lo:hi]], [None if pd.isna(x) else int(x) for x in pdf["edits"].iloc[lo:hi]]
                for d, i, e in zip(m["doc"], m["item"], m["edits"]):
                    items[d].append(i)
                    best[d] = e if best[d] is None else min(best[d], e)
                out = pd.DataFrame({"k": pdf["k"].iloc[lo:hi], "items": [sorted(set(x)) for x in items], "edits": pd.array(best, dtype="Int64")})
                yield out if last else out.assign(t=pdf["t"].iloc[lo:hi])
                lo, size = hi, 0

    return run


def scan(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, step: int = STEP, rate: float = RATE, min_item: int = MIN_ITEM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """key, items (ids found, ascending), edits (fewest, null if none), contaminated of each row; narrow, one pass a block."""
    kind = dict(docs.dtypes)[key]
    blocks = item_blocks(bench, item, item_text, block_bytes) or [[]]
    out = small_batches(docs).select(F.col(key).alias("k"), F.col(text).alias("t"))
    for n, block in enumerate(blocks):
        last = n + 1 == len(blocks)
        out = out.mapInPandas(_scan(block, (window, step, rate, min_item), last), f"k {kind}, items array<long>, edits long" + ", t string" * (not last))
    return out.select(F.col("k").alias(key), "items", "edits", (F.size("items") > 0).alias("contaminated"))


def _clean(block: list[tuple[int, str]], params: tuple, text_at: int):
    key = ("items", tuple(block), params)

    def run(batches):
        import pyarrow as pa

        index = held(key, lambda: Index(list(key[1]), *params))
        for b in slices(batches):
            texts = [(t or "").encode() for t in b.column(text_at).to_pylist()]
            bad: set[int] = set()
            lo = size = 0
            for hi in range(1, len(texts) + 1):
                size += len(texts[hi - 1])
                if size >= 1 << 20 or hi == len(texts):
                    bad.update(lo + d for d in index.matches(texts[lo:hi])["doc"])
                    lo, size = hi, 0
            yield b.filter(pa.array([i not in bad for i in range(len(texts))], pa.bool_()))

    return run


def clean(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, step: int = STEP, rate: float = RATE, min_item: int = MIN_ITEM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows that aren't contaminated, as they are; narrow, one pass a block of the benchmark."""
    for block in item_blocks(bench, item, item_text, block_bytes):
        docs = small_batches(docs).mapInArrow(_clean(block, (window, step, rate, min_item), docs.columns.index(text)), docs.schema)
    return docs
