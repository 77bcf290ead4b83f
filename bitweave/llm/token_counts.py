"""Token counts by overlap resynchronisation.

A text of up to ``chunk_chars`` characters is encoded whole. A longer one is encoded in chunks that overlap, each with
offsets, and two neighbours are spliced where both began a word of the pre-tokenizer: from such a place on, what the
tokenizer does depends only on what follows, so the later chunk's tokens are those of the whole text. A place counts
only if the earlier chunk had settled it: its word ended before that chunk's end, and no special string could reach
over the end. Where no such place lies in the overlap, the overlap doubles, at the worst until the chunk holds all of
the rest.

Nulls: a null text counts as empty (0 bytes, 0 tokens). Empty texts: 0 and 0. Repeated rows and ids: a row each.
Empty table: an empty result. Further columns of the input are ignored by :func:`token_counts`, whatever their names.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitweave.llm.held import held, small_batches

CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 1 << 10


def tokenizer(path: str):
    """The tokenizer of a .json file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _words(enc) -> list[tuple[int, int, int]]:
    """(token index, first character, last character + 1) of each word that the pre-tokenizer made, special tokens too."""
    out: list[list[int]] = []
    last: object = object()
    for k, (w, (a, b)) in enumerate(zip(enc.word_ids, enc.offsets)):
        if w is None or w != last:
            out.append([k, a, b])
        else:
            out[-1][2] = max(out[-1][2], b)
        last = w if w is not None else object()
    return [tuple(x) for x in out]


def encode_spliced(tok, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """The ids of the whole text, from encodings of overlapping chunks."""
    longest_special = max((len(t.content) for t in tok.get_added_tokens_decoder().values()), default=0) + 1
    n, ids, start = len(text), [], 0
    enc = tok.encode(text[:chunk], add_special_tokens=False)
    end, first = min(chunk, n), 0
    while end < n:
        words, width = _words(enc), overlap
        # A word that ends so far before the chunk's end that neither its own end nor a special string can change it.
        settled = [(start + a, k) for (k, a, _), (_, _, b) in zip(words[1:], words[:-1]) if start + a <= end - longest_special and start + b < end]
        settled = [(p, k) for p, k in settled if k >= first]
        while True:
            lo = max(start, end - width)
            hi = min(n, lo + max(chunk, 2 * width))
            nxt = tok.encode(text[lo:hi], add_special_tokens=False)
            begins = {lo + a: k for k, a, _ in _words(nxt)}
            at = next(((p, k) for p, k in reversed(settled) if p >= lo and p in begins and p < hi - longest_special), None)
            if at and at[0] > lo:
                ids += enc.ids[first : at[1]]
                first, start, end, enc = begins[at[0]], lo, hi, nxt
                break
            if lo == start:  # nothing before it is settled: the chunk itself must grow
                hi = min(n, end + width)
                enc = tok.encode(text[start:hi], add_special_tokens=False)
                # what was taken of this chunk so far began at a settled place: find it again
                if first:
                    first = _again(words, first, _words(enc))
                end = hi
                break
            width *= 2
    return ids + enc.ids[first:]


def _again(old: list[tuple[int, int, int]], first: int, new: list[tuple[int, int, int]]) -> int:
    at = next(a for k, a, _ in old if k == first)
    return next(k for k, a, _ in new if a == at)


def count_batches(path: str, chunk: int, overlap: int, key: str, text: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = held(("tokenizer", path), lambda: tokenizer(path))
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf[text]]
            n = [0] * len(texts)
            group: list[int] = []
            size = 0

            def flush() -> None:
                for i, e in zip(group, tok.encode_batch_fast([texts[i] for i in group], add_special_tokens=False)):
                    n[i] = len(e)
                group.clear()

            for i, t in enumerate(texts):
                if len(t) > chunk:
                    n[i] = len(encode_spliced(tok, t, chunk, overlap))
                elif t:
                    group.append(i)
                    size += len(t)
                    if size > 1 << 20:
                        flush()
                        size = 0
            flush()
            yield pd.DataFrame({key: pdf[key], "n_bytes": pdf["n_bytes"], "n_tokens": n})

    return run


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 1024, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Each row's key, UTF-8 bytes, tokens and whether these exceed ``limit``; a narrow plan, no shuffle."""
    kind = dict(docs.dtypes)[key]
    slim = small_batches(docs).select(F.col(key).alias("k"), F.col(text).alias("t"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    counted = slim.mapInPandas(count_batches(path, chunk, overlap, "k", "t"), f"k {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
