"""Clause machines: classifiers and encoders of conjunctive clauses whose literals are kept by teams of automata.

Input is a row's set of features; literals are the features present and those absent. Half of a class's clauses vote
for, half against. Classes (or output bits) learn independently, each in a group of its own on a bounded sample of rows
(``sample`` per class, by keyed hash); scoring is Arrow batches against the model, whose size is classes x clauses x
literals bits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitweave.operators.setjoin import hash_number


@dataclass(frozen=True)
class Settings:
    kind: str  # "classifier" or "encoder"
    outputs: int  # classes, or hidden bits
    features: int
    clauses: int = 80
    clause_tolerance: int = 8
    clause_maximum: int = 64
    specificity: float = 10.0
    target: float | None = None
    negative: float | None = None
    state_bits: int = 8
    include_bits: int = 1
    sample: int = 20_000
    seed: int = 1

    def rounded(self) -> "Settings":
        """Clauses in eights; the target by default sqrt(clauses / 2) * tolerance, a share of clauses if below 1."""
        c = -(-self.clauses // 8) * 8
        t = self.target if self.target is not None else math.sqrt(c / 2) * self.clause_tolerance
        return replace(self, clauses=c, target=max(1.0, t * c if t < 1 else t), negative=self.negative if self.negative is not None else 1.0 / max(1, self.outputs))


@dataclass
class Model:
    settings: Settings
    state: np.ndarray  # [outputs, clauses, literals] counters

    def included(self) -> np.ndarray:
        """A literal is in where its counter is in the upper part: above half, or in the top include_bits planes."""
        top = 1 << self.settings.state_bits
        return self.state >= top - (top >> self.settings.include_bits)

    def checkpoint(self) -> np.ndarray:
        return np.packbits(self.included(), axis=-1)

    def restore(self, actions: np.ndarray) -> None:
        """Takes inclusion from a checkpoint; counters move to either side of the boundary."""
        on = np.unpackbits(actions, axis=-1)[..., : self.state.shape[-1]].astype(bool)
        top = 1 << self.settings.state_bits
        edge = top - (top >> self.settings.include_bits)
        self.state = np.where(on, edge, edge - 1).astype(self.state.dtype)

    def restrict(self, outputs: list[int]) -> "Model":
        """The chosen outputs only, in that order."""
        if len(set(outputs)) < len(outputs):
            raise ValueError("an output is listed twice")
        return Model(replace(self.settings, outputs=len(outputs)), self.state[outputs])

    def reconfigure(self, **changes) -> "Model":
        """New settings; what was learnt goes."""
        return create(replace(self.settings, target=None, **changes))


def create(settings: Settings) -> Model:
    s = settings.rounded()
    top = 1 << s.state_bits
    return Model(s, np.full((s.outputs, s.clauses, 2 * s.features), top - (top >> s.include_bits) - 1, np.int16))


def literal_rows(sets: list, features: int) -> np.ndarray:
    """[rows, 2 * features] booleans: present, then absent."""
    x = np.zeros((len(sets), features), bool)
    for i, s in enumerate(sets):
        if s is not None and len(s):
            x[i, [f for f in s if 0 <= f < features]] = True
    return np.concatenate([x, ~x], 1)


def clause_votes(included: np.ndarray, x: np.ndarray, tolerance: int) -> np.ndarray:
    """[rows, clauses] votes of one output: an empty clause votes the tolerance; others min(L, tolerance) less what fails."""
    size = included.sum(-1)
    failed = (~x).astype(np.float32) @ included.T.astype(np.float32)
    return np.where(size == 0, tolerance, np.maximum(0, np.minimum(size, tolerance) - failed))


def signed_sum(votes: np.ndarray) -> np.ndarray:
    """Even clauses vote for, odd ones against."""
    return votes[..., ::2].sum(-1) - votes[..., 1::2].sum(-1)


def learn_output(s: Settings, state: np.ndarray, x: np.ndarray, y: np.ndarray, epochs: int, output: int) -> np.ndarray:
    """Trains one output's counters on rows x with wanted answers y, row by row in a seeded order."""
    rng = np.random.default_rng([s.seed, output])
    top = 1 << s.state_bits
    edge = top - (top >> s.include_bits)
    sign = np.where(np.arange(s.clauses) % 2 == 0, 1, -1)
    state = state.astype(np.int16)
    lose = max(1, int(2 * s.features / s.specificity))
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            on = state >= edge
            size = on.sum(1)
            failed = (on & ~x[i]).sum(1)
            votes = np.where(size == 0, s.clause_tolerance, np.maximum(0, np.minimum(size, s.clause_tolerance) - failed))
            v = float(np.clip((votes * sign).sum(), -s.target, s.target))
            p = (s.target - v) / (2 * s.target) if y[i] else (s.target + v) / (2 * s.target)
            chosen = rng.random(s.clauses) < p
            first = chosen & ((sign > 0) == bool(y[i]))
            fires = votes > 0
            grow = np.flatnonzero(first & fires)
            if len(grow):
                up = x[i][None, :] & (size[grow] <= s.clause_maximum)[:, None]
                down = ~x[i][None, :] & ~on[grow]
                state[grow] += up.astype(np.int16)
                state[grow] -= down.astype(np.int16)
            still = np.flatnonzero(first & ~fires)
            if len(still):
                at = rng.integers(0, 2 * s.features, (len(still), lose))
                state[still[:, None], at] -= 1
            other = np.flatnonzero(chosen & ~first & fires)
            if len(other):
                state[other] += (~x[i][None, :] & ~on[other]).astype(np.int16)
            np.clip(state, 0, top - 1, out=state)
    return state


def _questions(rows: DataFrame, s: Settings) -> DataFrame:
    """(output, id, features, y): for a classifier each row for its class and, by chance ``negative``, against others;
    for an encoder each row for every bit. At most ``sample`` a side and output, by keyed hash."""
    outputs = F.sequence(F.lit(0), F.lit(s.outputs - 1))
    draw = hash_number(F.lit(s.seed), F.col("id").cast("string"), F.col("output").cast("string"))
    if s.kind == "classifier":
        q = rows.where(F.col("label").between(0, s.outputs - 1)).select("id", "features", "label", F.explode(outputs).alias("output")).withColumn("y", F.col("label") == F.col("output"))
        q = q.where(F.col("y") | (draw / F.lit(float(1 << 32)) < s.negative))
    else:
        q = rows.select("id", "features", F.posexplode("bits").alias("output", "b")).select("id", "features", "output", (F.col("b") == 1).alias("y"))
    w = Window.partitionBy("output", "y").orderBy(draw, "id")
    return q.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= s.sample).select("output", "id", "features", "y")


def train(rows: DataFrame, model: Model, epochs: int, each: Callable | None = None) -> Model:
    """Learns from (id, features, label) or (id, features, bits). With ``each`` epochs are jobs of their own; False stops."""
    s = model.settings
    questions = _questions(rows, s)

    def learn(n: int, state: np.ndarray) -> np.ndarray:
        held = state

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id")
            o = int(pdf["output"].iloc[0])
            own = learn_output(s, held[o], literal_rows(pdf["features"].tolist(), s.features), pdf["y"].to_numpy(bool), n, o)
            return pd.DataFrame({"output": [o], "state": [own.astype("<i2").tobytes()]})

        got = questions.groupBy("output").applyInPandas(run, "output int, state binary").collect()
        out = state.copy()
        for r in got:
            out[r["output"]] = np.frombuffer(r["state"], "<i2").reshape(state.shape[1:])
        return out

    if each is None:
        return Model(s, learn(epochs, model.state))
    for e in range(epochs):
        model = Model(replace(s, seed=s.seed), learn(1, model.state))
        if each(e, model) is False:
            break
    return model


def predict(rows: DataFrame, model: Model, id: str = "id", features: str = "features") -> DataFrame:
    """(id, predicted): the class of the highest vote (the first of equals), or array<int> of bits with votes above 0."""
    s, included = model.settings, model.included()
    kind = dict(rows.dtypes)[id]
    out = "int" if s.kind == "classifier" else "array<int>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = literal_rows(pdf[features].tolist(), s.features)
            v = np.stack([signed_sum(clause_votes(inc, x, s.clause_tolerance)) for inc in included], 1) if len(pdf) else np.zeros((0, s.outputs))
            yield pd.DataFrame({id: pdf[id], "predicted": v.argmax(1).astype("int32") if s.kind == "classifier" else list((v > 0).astype("int32"))})

    return rows.select(id, features).mapInPandas(run, f"{id} {kind}, predicted {out}")


def predict_individual(rows: DataFrame, model: Model, id: str = "id") -> DataFrame:
    """(id, predicted) where each output has its own input: rows are (id, output, features)."""
    s, included = model.settings, model.included()
    kind = dict(rows.dtypes)[id]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = np.zeros(len(pdf))
            for o, g in pdf.groupby("output"):
                x = literal_rows(g["features"].tolist(), s.features)
                v[pdf.index.get_indexer(g.index)] = signed_sum(clause_votes(included[int(o)], x, s.clause_tolerance))
            yield pd.DataFrame({id: pdf[id], "output": pdf["output"], "v": v})

    votes = rows.select(id, F.col("output").cast("int").alias("output"), "features").mapInPandas(run, f"{id} {kind}, output int, v double")
    if s.kind == "classifier":
        return votes.groupBy(id).agg(F.max_by("output", F.struct("v", -F.col("output"))).alias("predicted"))
    return votes.groupBy(id).agg(F.transform(F.array_sort(F.collect_list(F.struct("output", (F.col("v") > 0).cast("int").alias("b")))), lambda z: z["b"]).alias("predicted"))
