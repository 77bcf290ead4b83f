"""Simhash codes of weighted, ranked sets: every feature votes on each bit of its rank by a keyed hash."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitweave.functions.bits import pack
from bitweave.operators.setjoin import hash_number

try:
    from _md5 import md5  # half the time of hashlib's
except ImportError:
    from hashlib import md5


def bits_of_ranks(n_bits: int, n_ranks: int, decay: float = 0.0) -> list[int]:
    """Bits of each rank: in equal parts, or by exp(-rank * decay); what is left over goes to rank 0."""
    w = [math.exp(-r * decay) for r in range(n_ranks)] if decay else [1.0] * n_ranks
    own = [int(n_bits * x / sum(w)) for x in w]
    own[0] += n_bits - sum(own)
    return own


def encode(index: DataFrame, n_bits: int, n_ranks: int = 1, n_quantiles: int = 1, decay: float = 0.0, seed: str = "simhash") -> DataFrame:
    """(id, code): a bit is 1 where the votes of the rank's features sum to 0 or more.

    A feature votes 1 or -1 by the hash of feature and bit, as often as its weight's place among n_quantiles of the
    largest weight, once at least. A rank without features hashes the id in place of one.
    """
    own = bits_of_ranks(n_bits, n_ranks, decay)
    begin = [sum(own[:r]) for r in range(n_ranks)]
    place = F.element_at(F.array(*map(F.lit, begin)), F.col("rank") + 1)
    width = F.element_at(F.array(*map(F.lit, own)), F.col("rank") + 1)
    feats = index.where(F.col("rank") < n_ranks).select("id", F.col("feature").cast("string").alias("f"), "rank", "weight")
    ids = index.select("id").distinct().withColumn("rank", F.explode(F.array(*map(F.lit, range(n_ranks)))))
    lone = ids.join(feats.select("id", "rank").distinct(), ["id", "rank"], "left_anti").select("id", F.concat(F.lit("id:"), F.col("id").cast("string")).alias("f"), "rank", F.lit(1.0).alias("weight"))
    if n_quantiles > 1:
        top = feats.agg(F.max("weight").alias("m")).first().m or 1.0
        times = F.greatest(F.lit(1), F.round(F.col("weight") / top * n_quantiles).cast("int"))
    else:
        times = F.lit(1)
    both = feats.unionByName(lone).where(width > 0).select("id", "f", "rank", times.alias("t"))
    # a feature is hashed once, not once a row; votes are summed in place, partially before the shuffle
    sign = lambda bit: F.when(hash_number(F.lit(seed), F.col("f"), bit.cast("string")) % 2 == 0, 1).otherwise(-1)
    signs = both.select("f", "rank").distinct().select("f", "rank", F.transform(F.sequence(place, place + width - 1), sign).alias("s"))
    sums = [F.sum(F.col("t") * F.get("s", i)).alias(f"v{i}") for i in range(max(own))]
    per_rank = both.join(signs, ["f", "rank"]).groupBy("id", "rank").agg(*sums)
    entries = F.array(*[F.struct((place + i).alias("bit"), (F.col(f"v{i}") >= 0).cast("int").alias("b")) for i in range(max(own))])
    kept = F.filter(entries, lambda x: x["b"].isNotNull())
    bits = per_rank.select("id", kept.alias("e")).groupBy("id").agg(F.map_from_entries(F.flatten(F.collect_list("e"))).alias("m"))
    return bits.select("id", pack(F.transform(F.sequence(F.lit(0), F.lit(n_bits - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))), n_bits).alias("code"))


#: Features whose signs a task keeps, and features of rows that are summed at once.
KEPT, TAKEN = 200_000, 262_144


def encode_sets(sets: DataFrame, n_bits: int, seed: str = "simhash") -> DataFrame:
    """(id, code) as :func:`encode` gives for one rank without weights, of sets (id, features) of distinct strings.

    One scan: a task hashes a feature when it first meets it, and nothing is shuffled. Empty sets have no code.
    """
    width = -(-n_bits // 32)

    tails, sign = [str(b).encode() for b in range(n_bits)], [1 if x % 2 == 0 else 255 for x in range(256)]

    def signs(f: str) -> bytes:
        head = f"{seed}:{f}:".encode()
        return bytes([sign[md5(head + t).digest()[3]] for t in tails])

    def run(batches):
        known: dict[str, bytes] = {}
        for batch in batches:
            begin, words = batch.column("features").offsets.to_numpy(), batch.column("features").values
            votes, first = np.zeros((batch.num_rows, n_bits), np.int32), 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(begin, begin[first] + TAKEN, side="right")) - 1)
                own = words.slice(begin[first], begin[last] - begin[first]).dictionary_encode()
                every = own.dictionary.to_pylist()
                if len(known) > KEPT:
                    known.clear()
                for f in every:
                    if f not in known:
                        known[f] = signs(f)
                s = np.frombuffer(b"".join([known[f] for f in every]), np.int8).reshape(len(every), n_bits)
                votes[first:last] = np.add.reduceat(s[own.indices.to_numpy()], begin[first:last] - begin[first], axis=0, dtype=np.int32)
                first = last
            bits = np.zeros((batch.num_rows, 32 * width), np.int64)
            bits[:, :n_bits] = votes >= 0
            code = (bits.reshape(-1, width, 32) << np.arange(32)).sum(axis=2)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * width, pa.int32()), pa.array(code.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], ["id", "code"])

    some = sets.where("size(features) > 0").select("id", "features")
    return some.mapInArrow(run, f"id {dict(sets.dtypes)['id']}, code array<long>")
