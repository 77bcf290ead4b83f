"""Token ids in files: frequency-ranked, byte-aligned variable-length coding with separate control bytes.

In a file ids are replaced by their rank of frequency over all documents of the file (ties: the smaller id first), so
that the most frequent 256 take one byte; the file holds its own ranking and needs no other. Four ranks share a control
byte, two bits each: bytes less one. A reader looks the 256 control bytes up in a table of four lengths, sums them and
gathers all ranks at once with numpy.

A folder holds ``ids-BBBBBBBB-PPPPPPPP.svb`` files, whose names in order are the documents in ascending order of their ids,
nulls first. A file: magic, documents, ids, ranks, control bytes, data bytes (each 8 bytes), then the id of each rank (4
bytes), per document a null flag (1 byte), its id (8 bytes) and its number of ids (8 bytes), then the control bytes
(each document begins a new one) and the data bytes.

One pass: documents are encoded and sent by range of id to the file they belong to; only ids are shuffled, never texts.
A file is written under a temporary name and moved, and its content depends only on the table, so that repeated tasks do
no harm. A range is split into several files at ``FILE_IDS`` ids.

Nulls: a null text is empty and has the end id alone; a null id sorts first. Repeated ids: each row is a document,
ordered by its number of ids, then its ids. Very long texts are
encoded whole. Empty table: no files, an empty result. Other columns are ignored, whatever
their names. Ids of documents must be whole numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitweave.llm.held import let_go, small_batches
from bitweave.llm.token_counts import tokenizer
from bitweave.llm.word_encoder import encoder, portions, ragged

MAGIC = 0x31425653
END_ID = 2
FILE_IDS = 16 << 20
#: A range of ids has so many documents about; ranges at the most, as their bounds go along with each task.
SHARD_DOCS, MOST_SHARDS = 20_000, 100_000
PART_IDS = 1 << 18  # ids that are packed or unpacked at once


def lengths_table() -> np.ndarray:
    b = np.arange(256)
    return np.stack([(b >> s & 3) + 1 for s in (0, 2, 4, 6)], 1).astype(np.int64)


LENGTHS = lengths_table()


def pack(ranks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes; ``counts``: ranks of each document."""
    r = ranks.astype(np.int64)
    code = (r > 0xFF).astype(np.int64) + (r > 0xFFFF) + (r > 0xFFFFFF)
    n_ctrl = -(-counts // 4)
    first = np.cumsum(counts) - counts
    slot = np.arange(len(r)) - np.repeat(first, counts) + np.repeat((np.cumsum(n_ctrl) - n_ctrl) * 4, counts)
    two = np.zeros(int(n_ctrl.sum()) * 4, np.uint8)
    two[slot] = code
    two = two.reshape(-1, 4)
    ctrl = two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6
    size = code + 1
    at = np.cumsum(size) - size
    total = int(size.sum())
    data = np.zeros(total, np.uint8)
    for k in range(4):
        has = code >= k if k else slice(None)
        data[at[has] + k] = (r[has] >> (8 * k)) & 0xFF
    return ctrl, data


def unpack(ctrl: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranks of all documents."""
    n_ctrl = -(-counts // 4)
    first = np.cumsum(counts) - counts
    all_sizes = LENGTHS[ctrl].ravel()
    slot = np.arange(int(counts.sum())) - np.repeat(first, counts) + np.repeat((np.cumsum(n_ctrl) - n_ctrl) * 4, counts)
    size = all_sizes[slot]
    at = np.cumsum(size) - size
    out = data[at].astype(np.uint32)
    for k in range(1, 4):
        has = np.flatnonzero(size > k)
        if len(has):
            out[has] |= data[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_bytes(path: str, *parts: bytes) -> None:
    """Under a temporary name first, then moved: a reader never sees half a file."""
    import uuid

    f, p = _fs(path.rsplit("/", 1)[0])
    name = path.rsplit("/", 1)[1]
    tmp = f"{p}/.{name}.{uuid.uuid4().hex}"
    with f.open_output_stream(tmp) as out:
        for x in parts:
            out.write(x)
    f.move(tmp, f"{p}/{name}")


def read_bytes(path: str) -> bytes:
    f, p = _fs(path.rsplit("/", 1)[0])
    with f.open_input_stream(f"{p}/{path.rsplit('/', 1)[1]}") as s:
        return s.read()


def _encode(path: str, end_id: int | None, bounds: list[int], kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        edge = np.array(bounds, np.int64)
        extra = int(end_id is not None)
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["t"]]
            for lo, hi in portions(texts):
                ids, n = enc.encode(texts[lo:hi])
                ends = np.cumsum(n + extra)
                flat = np.zeros(len(ids) + extra * len(n), kind)
                flat[ragged(ends - n - extra, n)] = ids
                if extra:
                    flat[ends - 1] = end_id
                flat, size = flat.tobytes(), np.dtype(kind).itemsize
                k = pdf["k"].iloc[lo:hi]
                known = k.notna().to_numpy()
                key = np.where(known, k.fillna(0).to_numpy(), 0).astype(np.int64)
                b = (ends * size).tolist()
                yield pd.DataFrame({
                    "bucket": np.where(known, np.searchsorted(edge, key, side="right"), 0).astype("int32"),
                    "known": known,
                    "k": key,
                    "n": n + extra,
                    "ids": [flat[x:y] for x, y in zip([0, *b[:-1]], b)],
                })

    return run


def encode_file(known: np.ndarray, key: np.ndarray, n: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """The parts of a file of these documents."""
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    some = np.flatnonzero(counts)
    ranks = some[np.lexsort((some, -counts[some]))].astype("<u4")
    rank = np.zeros(len(counts), np.uint32)
    rank[ranks] = np.arange(len(ranks), dtype=np.uint32)
    ctrl, data = [], []
    ends = np.cumsum(n)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PART_IDS, side="right")))
        c, d = pack(rank[ids[(ends[lo - 1] if lo else 0) : ends[hi - 1]]], n[lo:hi])
        ctrl.append(c.tobytes())
        data.append(d.tobytes())
        lo = hi
    head = np.array([MAGIC, len(n), len(ids), len(ranks), sum(map(len, ctrl)), sum(map(len, data))], "<i8").tobytes()
    return [head, ranks.tobytes(), known.astype(np.uint8).tobytes(), key.astype("<i8").tobytes(), n.astype("<i8").tobytes(), *ctrl, *data]


def _write(folder: str, file_ids: int, kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()  # the encoder's table
        held: list[pd.DataFrame] = []
        bucket, part, size = -1, 0, 0

        def flush() -> pd.DataFrame:
            pdf = pd.concat(held)
            n = pdf["n"].to_numpy()
            name = f"ids-{bucket:08d}-{part:08d}.svb"
            ids = np.frombuffer(b"".join(pdf["ids"]), kind)
            write_bytes(f"{folder}/{name}", *encode_file(pdf["known"].to_numpy(), pdf["k"].to_numpy(), n, ids))
            return pd.DataFrame({"name": [name], "n_docs": [len(pdf)], "n_ids": [int(n.sum())]})

        for pdf in batches:
            buckets, sizes = pdf["bucket"].to_numpy(), pdf["n"].to_numpy()
            lo = 0
            for i in range(len(pdf)):
                if buckets[i] != bucket or size + sizes[i] > file_ids:
                    if i > lo:
                        held.append(pdf.iloc[lo:i])
                    if held:
                        yield flush()
                    part = part + 1 if held and buckets[i] == bucket else 0
                    held.clear()
                    bucket, lo, size = int(buckets[i]), i, 0
                size += int(sizes[i])
            if lo < len(pdf):
                held.append(pdf.iloc[lo:])
        if held:
            yield flush()

    return run


def write(docs: DataFrame, folder: str, path: str, key: str = "doc_id", text: str = "text", end_id: int | None = END_ID, shards: int | None = None, file_ids: int = FILE_IDS) -> pd.DataFrame:
    """Writes all documents; returns the files in order: name, n_docs, n_ids, start. One row a file reaches the driver."""
    spark = docs.sparkSession
    shards = shards or max(1, min(MOST_SHARDS, docs.count() // SHARD_DOCS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    f, p = _fs(folder)
    f.create_dir(p, recursive=True)
    top = max(tokenizer(path).get_vocab_size(), (end_id or 0) + 1)
    kind = "<u2" if top <= 1 << 16 else "<u4"
    cuts = docs.select(F.percentile_approx(key, [i / shards for i in range(1, shards)] or [0.5], 10_000).alias("q")).first().q or []
    bounds = sorted({int(x) for x in cuts})
    coded = small_batches(docs).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInPandas(_encode(path, end_id, bounds, kind), "bucket int, known boolean, k long, n long, ids binary")
    placed = coded.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("bucket", "known", "k", "n", "ids")
    done = placed.mapInPandas(_write(folder, file_ids, kind), "name string, n_docs long, n_ids long").toPandas().sort_values("name", ignore_index=True)
    done["start"] = done["n_ids"].cumsum() - done["n_ids"]
    return done


def _read(folder: str, digests: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, start in zip(pdf["name"], pdf["start"]):
                raw = read_bytes(f"{folder}/{name}")
                magic, docs, _, ranks, nc, nd = np.frombuffer(raw, "<i8", 6).tolist()
                assert magic == MAGIC, f"{name} is no token file"
                ids = np.frombuffer(raw, "<u4", ranks, 48)
                at = 48 + 4 * ranks
                known = np.frombuffer(raw, np.uint8, docs, at).astype(bool)
                key = np.frombuffer(raw, "<i8", docs, at + docs)
                n = np.frombuffer(raw, "<i8", docs, at + 9 * docs)
                at += 17 * docs
                ctrl, data = np.frombuffer(raw, np.uint8, nc, at), np.frombuffer(raw, np.uint8, nd, at + nc)
                ends, c_ends = np.cumsum(n), np.cumsum(-(-n // 4))
                firsts = ends - n + start
                lo = at_data = 0
                while lo < docs:  # some documents at a time, so that a file needs little more memory than its bytes
                    hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PART_IDS, side="right")))
                    c = ctrl[(c_ends[lo - 1] if lo else 0) : c_ends[hi - 1]]
                    own = n[lo:hi]
                    size = _data_bytes(c, own)
                    flat = ids[unpack(c, data[at_data : at_data + size], own)].astype("<u4")
                    at_data += size
                    e = np.cumsum(own)
                    parts = [flat[b - m : b] for b, m in zip(e.tolist(), own.tolist())]
                    out = pd.DataFrame({"k": pd.array(np.where(known[lo:hi], key[lo:hi], 0), dtype="Int64"), "start": firsts[lo:hi], "n_tokens": own})
                    out.loc[~known[lo:hi], "k"] = pd.NA
                    if digests:
                        out["ids_crc32"] = [zlib.crc32(x) for x in parts]
                    else:
                        out["ids"] = [x.astype(np.int64) for x in parts]
                    yield out
                    lo = hi

    return run


def _data_bytes(ctrl: np.ndarray, counts: np.ndarray) -> int:
    """Data bytes of whole documents: their lengths without those of the unused places, which are coded as 1."""
    return int(LENGTHS.sum(1)[ctrl].sum() - ((-counts) % 4).sum())


def read(spark: SparkSession, folder: str, files: pd.DataFrame, key: str = "doc_id", digests: bool = False) -> DataFrame:
    """key, start, n_tokens and ids (or ids_crc32) of each document, from the files alone."""
    last = "ids_crc32 long" if digests else "ids array<long>"
    if not len(files):
        return spark.createDataFrame([], f"{key} long, start long, n_tokens long, {last}")
    listed = spark.createDataFrame(files[["name", "start"]].astype({"name": "object"}), "name string, start long").repartition(len(files), "name")
    return listed.mapInPandas(_read(folder, digests), f"k long, start long, n_tokens long, {last}").withColumnRenamed("k", key)
