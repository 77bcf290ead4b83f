"""Removal of repeated 200-byte strings, by parsing the corpus at rolling-hash triggers.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts anywhere else in the corpus. What must be
known is thus, of every place, whether the string that starts there occurs twice.

A rolling hash of ``GRAM`` bytes triggers where it is the smallest of a string (the leftmost of equals). That depends on
the string alone, so equal strings have their trigger at the same offset, wherever they occur. Places whose strings share
a trigger form a phrase: a run of places, some 70 of them, all of whose strings hold the trigger's bytes. The parse into
phrases takes the role that it has in prefix-free parsing: the corpus is only compared phrase by phrase, and only where
phrases recur place by place. Equality is by 128-bit fingerprints, taken from running sums in constant time:

1. core: a phrase whose trigger bytes occur once holds no repeat. That settles all text that nothing repeats.
2. whole: where all the bytes of a phrase's strings together occur elsewhere, all of its places are repeats.
3. blocks: what remains lies at the ends of repeats. It is cut into blocks of ``BLOCK`` places by distance from the
   trigger, alike in every copy, with the same two tests.
4. places: single places of the few blocks left.

A phrase that is settled may still hold the copy of a place that isn't: of phrases with equal trigger bytes among which
one isn't settled, one of each distinct text goes on to the next round; blocks likewise.

Each round counts fingerprints. Within a batch of a task equal ones are merged first: one witness goes to the shuffle,
and what is known to repeat is marked at once, so a passage that a third of all documents hold sends a row a batch. What
a round settles is written to the shared folder; from round 2 on only documents with a repeated core are read.

Nulls: a null text is empty. Texts under LENGTH bytes have nothing removed. A null id is an id like others. Repeated rows
(same id, same text) are documents of their own, each the other's copy. Very long texts are parsed in pieces that overlap,
so memory stays bounded. Empty table: an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitweave.llm.held import small_batches
from bitweave.llm.shingles import mix
from bitweave.llm.word_encoder import ragged
from bitweave.session import Staging, stage

LENGTH, GRAM, BLOCK = 200, 64, 8
PIECE = 1 << 20
_rng = np.random.default_rng(77)
_BYTES = _rng.integers(0, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15 | 3, 0xC2B2AE3D27D4EB4F | 3)
_powers: list = []


def _grown(n: int) -> list:
    if not _powers or len(_powers[0][0]) <= n:
        _powers.clear()
        for base in _BASES:
            pair = []
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.full(n + 1, b, np.uint64)
                p[0] = 1
                pair.append(np.multiply.accumulate(p))
            _powers.append(pair)
    return _powers


class Portion:
    """Pieces of documents, about PIECE bytes in all, with their phrases.

    doc, lo, hi, at: of each phrase the row of its document, its first and last place and its trigger, as offsets in the
    document. Places of a document are in exactly one phrase each.
    """

    def __init__(self, rows: list[int], bases: list[int], parts: list[bytes], length: int, gram: int):
        self.length = length
        buf = np.frombuffer(b"".join(parts), np.uint8)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        first = np.cumsum(size) - size
        n = len(buf)
        self.sums = []
        for (up, self_down), table in zip(_grown(max(n, 2 * PIECE)), _BYTES):
            s = np.zeros(n + 1, np.uint64)
            np.cumsum(table[buf] * up[:n], out=s[1:])
            self.sums.append((s, self_down))
        s, down = self.sums[0]
        h = mix((s[gram:] - s[:-gram]) * down[: n - gram + 1])
        low = np.uint64((1 << 23) - 1)
        m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        want, width = length - gram + 1, 1
        while width * 2 <= want:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < want:
            m = np.minimum(m[: len(m) - (want - width)], m[want - width :])
        places = size - length + 1
        valid = ragged(first, places)
        piece = np.repeat(np.arange(len(parts)), places)
        t = (m[valid] & low).astype(np.int64)
        new = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (piece[1:] != piece[:-1])])
        last = np.r_[new[1:], len(t)] - 1
        p = piece[new]
        self.shift = (np.array(bases, np.int64) - first)[p]  # from the buffer to the document
        self.doc = np.array(rows, np.int64)[p]
        self.lo, self.hi, self.at = valid[new] + self.shift, valid[last] + self.shift, t[new] + self.shift

    def prints(self, phrase: np.ndarray, a: np.ndarray, b: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit fingerprints of the bytes a to b of the documents that hold the phrases."""
        a, b = a - self.shift[phrase], b - self.shift[phrase]
        out = []
        for s, down in self.sums:
            out.append(mix((s[b] - s[a]) * down[a] + np.uint64(kind * 0x9E3779B97F4A7C15 & (2**64 - 1))))
        return out[0], out[1]


def portions(raw: list[bytes], length: int = LENGTH, gram: int = GRAM, piece: int = PIECE) -> Iterator[Portion]:
    rows, bases, parts, total = [], [], [], 0
    for i, t in enumerate(raw):
        for a in range(0, len(t) - length + 1, piece):
            rows.append(i)
            bases.append(a)
            parts.append(t[a : a + piece + length - 1] if len(t) > piece else t)
            total += len(parts[-1])
            if total >= piece:
                yield Portion(rows, bases, parts, length, gram)
                rows, bases, parts, total = [], [], [], 0
    if parts:
        yield Portion(rows, bases, parts, length, gram)


class Known:
    """Numbers found for documents, by row and number."""

    def __init__(self, lists: pd.Series):
        n = [0 if x is None else len(x) for x in lists]
        self.keys = np.sort(np.repeat(np.arange(len(n), dtype=np.int64) << 40, n) | np.concatenate([np.asarray(x, np.int64) for x in lists if x is not None and len(x)] or [np.zeros(0, np.int64)]))

    def has(self, row: np.ndarray, number: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(row), bool)
        k = row << 40 | number
        at = np.searchsorted(self.keys, k)
        at[at == len(self.keys)] = 0
        return self.keys[at] == k


def blocks(p: Portion, some: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """phrase, distance of its nearest place, first and last own place of each block of the phrases ``some``."""
    near, far = (p.at - p.hi)[some] // block, (p.at - p.lo)[some] // block
    n = far - near + 1
    k = ragged(near, n)
    ph = np.repeat(some, n)
    return ph, k * block, np.maximum(p.lo[ph], p.at[ph] - k * block - block + 1), np.minimum(p.hi[ph], p.at[ph] - k * block)


def _round(which: int, length: int, gram: int, block: int, piece: int):
    """Mapper of a round: the fingerprints it asks about, merged within the batch."""

    def ask(pdf: pd.DataFrame) -> list[np.ndarray]:
        """Group, fingerprint (2), row, number of each question."""
        got = []
        raw = [t.encode() if isinstance(t, str) else b"" for t in pdf["t"]]
        known = {c: Known(pdf[c]) for c in ("core", "ask_whole", "ask_block") if c in pdf}
        for p in portions(raw, length, gram, piece):
            if which == 1:
                every = np.arange(len(p.doc))
                x = p.prints(every, p.at, p.at + gram, 1)[0]  # a filter: half the fingerprint does
                got.append((np.zeros_like(x), x, np.zeros_like(x), p.doc, p.lo))
                continue
            some = np.flatnonzero(known["core" if which == 2 else "ask_whole"].has(p.doc, p.lo))
            if which == 2:
                group = p.prints(some, p.at[some], p.at[some] + gram, 1)[0]
                got.append((group, *p.prints(some, p.lo[some], p.hi[some] + length, 2), p.doc[some], p.lo[some]))
                continue
            ph, near, a, b = blocks(p, some, block)
            if which == 3:
                group = p.prints(ph, p.at[ph] - near, p.at[ph] - near - block + 1 + length, 3)[0]
                x, y = p.prints(ph, a, b + length, 4)
                part = b - a + 1 < block  # not whole here: settled by its places only, so equal to nothing
                x[part] = mix((p.doc[ph[part]] << 40 | a[part]).astype(np.uint64) + salt(pdf))
                y[part] = 0
                got.append((group, x, y, p.doc[ph], a))
                continue
            on = known["ask_block"].has(p.doc[ph], a)
            ph, a, b = ph[on], a[on], b[on]
            i = ragged(a, b - a + 1)
            ph = np.repeat(ph, b - a + 1)
            x, y = p.prints(ph, i, i + length, 5)
            got.append((np.zeros_like(x), x, y, p.doc[ph], i))
        return [np.concatenate(x) for x in zip(*got)] if got else []

    def salt(pdf: pd.DataFrame) -> np.uint64:
        return np.uint64(int.from_bytes(hashlib.blake2b(f"{pdf['d'].iloc[0]}:{pdf['x'].iloc[0]}:{len(pdf)}".encode(), digest_size=8).digest(), "little"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for nth, pdf in enumerate(batches):
            got = ask(pdf)
            if not got or not len(got[0]):
                continue
            group, x, y, row, number = got
            order = np.lexsort((y, x, group))
            group, x, y, row, number = (v[order] for v in (group, x, y, row, number))
            new = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (group[1:] != group[:-1])])
            n = np.diff(np.r_[new, len(x)])
            # of equal ones the first asks for all, with a weight of two; the others are settled, under keys of their own
            own = np.ones(len(x), bool)
            own[new] = False
            w = np.where(np.repeat(n > 1, n), 2, 1).astype("int32")
            lone = mix((row[own] << 40 | number[own]).astype(np.uint64) + salt(pdf) + np.uint64(nth))
            group[own] = lone
            x[own] = lone
            yield pd.DataFrame({"g": group.view(np.int64), "x": x.view(np.int64), "y": y.view(np.int64), "w": w, "own": own, "d": pdf["d"].to_numpy()[row], "h": pdf["x"].to_numpy()[row], "number": number})

    return run


def _spans(length: int, gram: int, block: int, piece: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = [t.encode() if isinstance(t, str) else b"" for t in pdf["t"]]
            known = {c: Known(pdf[c]) for c in ("core", "whole", "block", "place")}
            doc, lo, hi = [], [], []
            for p in portions(raw, length, gram, piece):
                some = np.flatnonzero(known["core"].has(p.doc, p.lo))
                all_in = known["whole"].has(p.doc[some], p.lo[some])
                w, some = some[all_in], some[~all_in]
                ph, _, a, b = blocks(p, some, block)
                all_in = known["block"].has(p.doc[ph], a)
                doc += [p.doc[w], p.doc[ph[all_in]]]
                lo += [p.lo[w], a[all_in]]
                hi += [p.hi[w], b[all_in]]
            k = known["place"].keys
            doc.append(k >> 40)
            lo.append(k & ((1 << 40) - 1))
            hi.append(lo[-1])
            doc, lo, hi = map(np.concatenate, (doc, lo, hi))
            order = np.lexsort((lo, doc))
            doc, lo, hi = doc[order], lo[order], hi[order] + length  # removed: [lo, hi)
            # runs: a stretch that begins beyond all ends before it in its document begins a new one
            top = np.maximum.accumulate(hi + (doc << 40)) if len(doc) else hi
            new = np.flatnonzero(np.r_[True, (lo[1:] + (doc[1:] << 40)) > top[:-1]]) if len(doc) else np.zeros(0, np.int64)
            last = np.r_[new[1:], len(doc)] - 1
            first_row = np.searchsorted(doc[new], np.arange(len(raw) + 1))
            run_lo, run_hi = lo[new], (top[last] & ((1 << 40) - 1)) if len(new) else lo[:0]
            out = []
            for i, t in enumerate(raw):
                s, e = run_lo[first_row[i] : first_row[i + 1]].tolist(), run_hi[first_row[i] : first_row[i + 1]].tolist()
                digest, at = hashlib.sha256(), 0
                view = memoryview(t)
                for a, b in zip(s, e):
                    digest.update(view[at:a])
                    at = b
                digest.update(view[at:])
                out.append((sum(e) - sum(s), len(s), digest.hexdigest(), [[a, b] for a, b in zip(s, e)]))
            yield pd.DataFrame({"d": pdf["d"], "x": pdf["x"], "n_removed": [o[0] for o in out], "n_spans": [o[1] for o in out], "kept_sha256": [o[2] for o in out], "spans": [o[3] for o in out]})

    return run


def _found(rows: DataFrame, name: str) -> DataFrame:
    """(d, x, list of numbers) of what occurs twice.

    What a batch knows to repeat is settled as it is. Of the rest fingerprints are counted, merged before the shuffle, and
    those that repeat are joined back; a hot one's join may be split.
    """
    with Staging(rows.sparkSession) as asked:
        rows = stage(rows, "asked")
    rest = rows.where("not own")
    often = rest.groupBy("x", "y").agg(F.sum("w").alias("n")).where("n > 1").select("x", "y")
    hit = rows.where("own").select("d", "h", "number").unionByName(rest.join(often.hint("merge"), ["x", "y"]).select("d", "h", "number"))
    found = stage(hit.groupBy("d", F.col("h").alias("x")).agg(F.collect_set("number").alias(name)), name)
    asked.sweep()
    return found


def _settled(rows: DataFrame, name: str) -> DataFrame:
    """(d, x, settled numbers, numbers that go on): by fingerprint within the group of equal cores; sums as in _found."""
    with Staging(rows.sparkSession) as asked:
        rows = stage(rows, "asked")
    rest = rows.where("not own")
    each = rest.groupBy("g", "x", "y").agg(F.sum("w").alias("n"), F.min(F.struct("d", "h", "number")).alias("one"))
    group = each.groupBy("g").agg(F.sum("n").alias("total"), (F.min("n") < 2).alias("open")).where("total > 1")
    each = each.join(group.hint("merge"), "g")  # the others neither settle nor go on
    r = rest.join(each.hint("merge"), ["g", "x", "y"])
    goes = F.col("open") & ((F.col("n") < 2) | (F.struct("d", "h", "number") == F.col("one")))
    r = r.select("d", F.col("h").alias("x"), F.when(F.col("n") > 1, F.col("number")).alias("settled"), F.when(goes, F.col("number")).alias("goes")).where("settled is not null or goes is not null")
    r = r.unionByName(rows.where("own").select("d", F.col("h").alias("x"), F.col("number").alias("settled"), F.lit(None).cast("long").alias("goes")))
    found = stage(r.groupBy("d", "x").agg(F.collect_set("settled").alias(name), F.collect_set("goes").alias(f"ask_{name}")), name)
    asked.sweep()
    return found


def removed_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """(d, x, t) of all documents, and of those with a removal (d, x, n_removed, n_spans, kept_sha256, spans).

    d is the id as text, x a hash of the text that tells rows of one id apart.
    """
    if not 1 <= gram <= length:
        raise ValueError("the trigger must fit into the string")
    d = small_batches(docs).select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("d"), F.hash(text).alias("x"), F.col(text).alias("t"))
    kinds = "g long, x long, y long, w int, own boolean, d string, h int, number long"
    ask = lambda df, k: df.mapInPandas(_round(k, length, gram, block, piece), kinds)
    core = _found(ask(d, 1), "core")
    some = stage(d.join(core, ["d", "x"]), "repeated")
    whole = _settled(ask(some, 2), "whole")
    with_whole = some.join(whole, ["d", "x"], "left")
    block_ = _settled(ask(with_whole.where("size(ask_whole) > 0").drop("core", "whole"), 3), "block")
    with_block = with_whole.join(block_, ["d", "x"], "left")
    place = _found(ask(with_block.where("size(ask_block) > 0").drop("core", "whole", "block"), 4), "place")
    return d, with_block.join(place, ["d", "x"], "left").mapInPandas(_spans(length, gram, block, piece), "d string, x int, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    _, gone = removed_spans(docs, key, text, **params)
    gone = stage(gone.drop("spans").distinct(), "removed").select(F.col("d").alias("_d"), F.col("x").alias("_x"), "n_removed", "n_spans", "kept_sha256")
    t = F.coalesce(F.col(text), F.lit("")).cast("binary")
    all_ = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("d"), F.hash(text).alias("x"), F.octet_length(t).cast("long").alias("n_bytes"), F.sha2(t, 256).alias("sha"))
    j = all_.join(gone, (F.col("d") == F.col("_d")) & (F.col("x") == F.col("_x")), "left")
    return j.select(F.col("_k").alias(key), "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
