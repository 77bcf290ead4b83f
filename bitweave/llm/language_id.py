"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of labelled text. A text is parsed greedily into the longest phrases that occur in
that training text; the language whose parse needs the fewest phrases, each weighed by the bits that name a place in its
training text, is the prediction. Phrases times those bits over the length estimates the cross entropy.

Texts are first reduced to letters of either case with one blank between words, as UTF-8 bytes; bytes that no training
text has end a phrase. The whole text is parsed, in blocks of ``block`` bytes that each begin a phrase anew, which lets
numpy step all blocks of all texts at once: an automaton is a table, and one look-up yields the next state and whether a
phrase ended there.

Training reads at most ``train_docs`` documents per language and ``train_chars`` characters of each, chosen by a keyed
hash among eligible rows; that bound is fixed, whatever the size of the table.

Score: the share of the best language among all, weighing each by 2 to the power of minus its bits, which is in 0 to 1.
A text with no letter, or null, is ``und`` with score 0. Ties fall to the language first in code point order. Nulls: rows
with a null label never train. Repeated rows: each gets its row. Empty table, or no labelled text: all are ``und``, score
0. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitweave.llm.held import give_back, held, small_batches
from bitweave.llm.word_encoder import portions

TRAIN_DOCS, TRAIN_CHARS, BLOCK = 48, 768, 512
_NOT_LETTER = re.compile(r"[\W\d_]+")


def reduce_text(text: str) -> str:
    return _NOT_LETTER.sub(" ", text).strip().lower()


def automaton(data: bytes, classes: np.ndarray, n_classes: int) -> np.ndarray:
    """The suffix automaton of ``data`` as a table [states, classes]: next state * 2 + (a phrase ended before this byte).

    Where a state has no move the phrase ends and the byte begins another from the root; a byte that the root doesn't
    know is a phrase of its own.
    """
    nxt: list[dict] = [{}]
    link, length, last = [-1], [0], 0
    for c in classes[np.frombuffer(data, np.uint8)].tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    lost = len(nxt)  # the state behind a byte that the root doesn't know: whatever follows begins a phrase
    root = np.full(n_classes, lost, np.int32)
    for c, s in nxt[0].items():
        root[c] = s
    table = np.tile(root * 2 + 1, (lost + 1, 1)).astype(np.int32)
    table[0] = root * 2
    s = np.repeat(np.arange(lost), [len(m) for m in nxt])
    table[s, np.fromiter((c for m in nxt for c in m), np.int64, len(s))] = np.fromiter((v for m in nxt for v in m.values()), np.int64, len(s)) * 2
    return table


class Model:
    """All languages' automata in one table; the states of language k begin at ``roots[k]``."""

    def __init__(self, samples: list[tuple[str, str]]):
        self.langs = [lang for lang, _ in samples]
        data = [text.encode() for _, text in samples]
        seen = sorted(set(b"".join(data)))
        self.classes = np.zeros(256, np.uint8)
        self.classes[seen] = np.arange(1, len(seen) + 1)
        width = len(seen) + 1
        # a state is held as its row's offset * 2, so that a step is one addition and one look-up
        kind = np.int32 if sum(2 * len(d) + 2 for d in data) * width * 2 < 2**31 else np.int64
        tables, roots, at = [], [], 0
        for d in data:
            t = automaton(d, self.classes, width).astype(kind, copy=False)
            ended = t & 1
            t >>= 1
            t += at
            t *= width * 2
            t += ended
            tables.append(t)
            roots.append(at * width * 2)
            at += len(t)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, kind)
        del tables
        give_back()
        self.roots = np.array(roots, self.table.dtype)
        self.bits = np.array([np.log2(max(2, len(d))) for d in data])

    def phrases(self, texts: list[bytes], block: int = BLOCK) -> np.ndarray:
        """Phrases of each text under each language."""
        n = np.array([len(t) for t in texts])
        blocks = -(-n // block)
        owner = np.repeat(np.arange(len(texts)), blocks)
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        if not len(owner):
            return out
        codes = self.classes[np.frombuffer(b"".join(texts), np.uint8)].astype(self.table.dtype)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = np.repeat(np.cumsum(n) - n, blocks) + nth * block
        length = np.minimum(block, np.repeat(n, blocks) - nth * block)
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        steps = int(length[0])
        live = np.searchsorted(-length, -np.arange(steps), side="left")  # blocks longer than step s come first
        table = self.table
        for k, root in enumerate(self.roots):
            state = np.full(len(start), root, table.dtype)
            count = np.zeros(len(start), np.int32)
            for s in range(steps):
                m = live[s]
                v = table[(state[:m] >> 1) + codes[start[:m] + s]]
                e = v & 1
                count[:m] += e
                state[:m] = v - e
            out[:, k] = np.bincount(owner[order], weights=count + 1, minlength=len(texts))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and bits a letter of the best."""
        lang, score, rate = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        if not self.langs:
            return lang, score, rate
        for lo, hi in portions([t if isinstance(t, str) else "" for t in texts]):
            flat = [reduce_text(t).encode() if isinstance(t, str) else b"" for t in texts[lo:hi]]
            some = [i for i, t in enumerate(flat) if t]
            if not some:
                continue
            cost = self.phrases([flat[i] for i in some]) * self.bits
            best = cost.argmin(1)
            share = np.exp2(-np.minimum(cost - cost.min(1, keepdims=True), 1000))
            at = np.array(some) + lo
            for i, b in zip(at.tolist(), best):
                lang[i] = self.langs[b]
            score[at] = 1 / share.sum(1)
            rate[at] = cost.min(1) / np.array([len(flat[i]) for i in some])
        return lang, score, rate


def training_sample(rows: DataFrame, key: str, text: str, lang: str, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> list[tuple[str, str]]:
    """(language, text) of at most ``train_docs`` * ``train_chars`` characters a language, in code point order.

    Ids are ranked first, on narrow columns with a per-partition limit; texts are read for the chosen ids alone.
    """
    labelled = rows.where(F.col(lang).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("l"))
    w = Window.partitionBy("l").orderBy(F.md5(F.col("k").cast("string").cast("binary")), "k")
    chosen = [r.k for r in labelled.withColumn("r", F.row_number().over(w)).where(F.col("r") <= train_docs).select("k").distinct().collect()]
    if not chosen:
        return []
    got = rows.where(F.col(key).isin(chosen) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("l"), F.substring(text, 1, train_chars).alias("t")).distinct().collect()
    by: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: (r.l, r.t)):
        by.setdefault(r.l, []).append(reduce_text(r.t))
    return [(k, " ".join(v)) for k, v in sorted(by.items()) if any(v)]


def _model(samples: tuple) -> Model:
    return held(("languages", samples), lambda: Model(list(samples)))


def predict(docs: DataFrame, samples: list[tuple[str, str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score, bits_per_letter of each row; a narrow plan."""
    kind = dict(docs.dtypes)[key]
    held = tuple(samples)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(held)
        for pdf in batches:
            lang, score, rate = model.predict(pdf["t"].tolist())
            yield pd.DataFrame({"k": pdf["k"], "lang_pred": lang, "score": score, "bits_per_letter": rate})

    slim = small_batches(docs).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return slim.mapInPandas(run, f"k {kind}, lang_pred string, score double, bits_per_letter double").withColumnRenamed("k", key)


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, held_out, lang_pred, score: trained on rows whose id's crc32 leaves no 1 on division by 3."""
    samples = training_sample(docs.where(~held_out(key)), key, text, lang)
    p = predict(docs, samples, key, text)
    return p.select(key, F.coalesce(held_out(key), F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_letter")


def slices(batches, rows: int = 1_000):
    """Smaller parts of Arrow batches, so that a task holds few Python strings at once."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def keep(docs: DataFrame, samples: list[tuple[str, str]], text: str = "text", lang: str = "lang", least: float = 0.5) -> DataFrame:
    """The rows with a language: neither ``und`` nor scored under ``least``; a null label gets the prediction. Narrow."""
    held = tuple(samples)
    text_at, lang_at = docs.columns.index(text), docs.columns.index(lang)

    def run(batches):
        import pyarrow as pa

        model = _model(held)
        for b in slices(batches):
            pred, score, _ = model.predict(b.column(text_at).to_pylist())
            own = b.column(lang_at).to_pylist()
            cols = list(b.columns)
            cols[lang_at] = pa.array([o if o is not None or p == "und" else p for o, p in zip(own, pred)], b.schema.field(lang_at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema).filter(pa.array([p != "und" and s >= least for p, s in zip(pred, score.tolist())], pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)
