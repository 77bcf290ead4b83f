"""Hyper-parameter search and the composed pipelines it tunes."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitweave.operators import binarize, clause_machine, graph, hamming, metrics, spectral


@dataclass
class Sampler:
    """fixed value; range with ``low`` and ``high`` (log, whole, powers of two, rounded to ``step``); or a list of values.

    A range is drawn around ``centre`` with a spread of ``jitter`` times its width, reflected at its bounds.
    """

    fixed: Any = None
    low: float | None = None
    high: float | None = None
    values: list | None = None
    log: bool = False
    whole: bool = False
    pow2: bool = False
    step: float | None = None
    centre: float | None = None
    jitter: float = 1.0

    @property
    def is_fixed(self) -> bool:
        return self.low is None and self.values is None

    def _in(self, v: float) -> float:
        return math.log2(v) if self.pow2 else math.log(v) if self.log else v

    def draw(self, rng: random.Random) -> Any:
        if self.is_fixed:
            return self.fixed
        if self.values is not None:
            if self.centre is not None and rng.random() > self.jitter:
                return self.values[int(self.centre)]
            return rng.choice(self.values)
        a, b = self._in(self.low), self._in(self.high)
        v = rng.uniform(a, b) if self.centre is None else rng.gauss(self._in(self.centre), self.jitter * (b - a) / 2)
        for _ in range(8):
            v = 2 * a - v if v < a else 2 * b - v if v > b else v
        v = min(b, max(a, v))
        v = 2.0 ** round(v) if self.pow2 else math.exp(v) if self.log else v
        if self.step:
            v = round(v / self.step) * self.step
        return int(round(v)) if self.whole or self.pow2 else v

    def recenter(self, value: Any) -> None:
        if self.values is not None:
            self.centre = self.values.index(value) if value in self.values else None
        elif not self.is_fixed:
            self.centre = value


def build_sampler(spec: Any) -> Sampler:
    """A sampler from a value, a list, or a dict of :class:`Sampler`'s fields."""
    if isinstance(spec, Sampler):
        return spec
    if isinstance(spec, dict):
        return Sampler(**spec)
    if isinstance(spec, (list, tuple)):
        return Sampler(values=list(spec))
    return Sampler(fixed=spec)


def all_fixed(samplers: dict[str, Sampler]) -> bool:
    return all(s.is_fixed for s in samplers.values())


def success_factor(rate: float) -> float:
    """Jitter stays after more than a fifth of successes, shrinks to 0.8 after more than a twentieth, else to a half."""
    return 1.0 if rate > 0.2 else 0.8 if rate > 0.05 else 0.5


@dataclass
class Found:
    params: dict
    score: float
    result: Any = None
    history: list = field(default_factory=list)


def search(specs: dict[str, Any], trial: Callable[[dict], tuple[float, Any]], rounds: int = 3, trials: int = 10, tolerance: float = 1e-8, make_key: Callable[[dict], Any] | None = None, seed: int = 1, final: Callable[[dict], tuple[float, Any]] | None = None) -> Found:
    """The best parameters: rounds of trials around the best so far, with a jitter that follows the successes.

    Parameters drawn before (by ``make_key``) aren't tried again. With everything fixed one trial is made.
    """
    samplers = {k: build_sampler(v) for k, v in specs.items()}
    rng = random.Random(seed)
    make_key = make_key or (lambda p: tuple(sorted((k, repr(v)) for k, v in p.items())))
    best, seen, history = None, {}, []
    for _ in range(1 if all_fixed(samplers) else rounds):
        won = 0
        for _ in range(1 if all_fixed(samplers) else trials):
            p = {k: s.draw(rng) for k, s in samplers.items()}
            key = make_key(p)
            if key in seen:
                continue
            score, result = trial(p)
            seen[key] = score
            history.append((p, score))
            if best is None or score > best.score + tolerance:
                best, won = Found(p, score, result), won + 1
        for k, s in samplers.items():
            s.recenter(best.params[k])
            s.jitter *= success_factor(won / max(1, trials))
    if final:
        score, result = final(best.params)
        best = Found(best.params, score, result)
    best.history = history
    return best


# --- threshold functions: fit once, then encode any rows ---


def fit_threshold(kind: str, rows: DataFrame, n: int, id: str = "id", vec: str = "z", **options) -> Callable[[DataFrame], DataFrame]:
    """A function from (id, vec) to (id, code): "sign", "median", "otsu" or "itq"."""
    if kind == "sign":
        return lambda d: binarize.sign(d, n, vec).select(id, "code")
    if kind == "median":
        fitted = binarize.median_thresholds(rows, vec)
        return lambda d: binarize.apply_thresholds(d, fitted, n, vec).select(id, "code")
    if kind == "otsu":
        fitted = binarize.otsu_thresholds(rows, vec, **options)
        return lambda d: binarize.apply_thresholds(d, fitted, n, vec).select(id, "code")
    if kind == "itq":
        mean, rotation = binarize.itq_fit(rows, vec, **options)
        return lambda d: binarize.itq_encode(d, mean, rotation, id, vec)
    raise ValueError(f"no threshold {kind}")


THRESHOLDS = ("itq", "otsu", "median", "sign")


# --- pipelines ---


def build_adjacency(nodes: DataFrame, hoods: DataFrame, settings: graph.Adjacency, **sources) -> DataFrame:
    from bitweave.session import stage

    return stage(graph.adjacency(nodes, settings, hoods, **sources), "adjacency")


def build_spectral(nodes: DataFrame, edges: DataFrame, n: int, kind: str = "normalized", threshold: str = "median") -> tuple[DataFrame, DataFrame, list[float]]:
    """(codes, vectors, eigenvalues) of a graph."""
    z, values = spectral.eigen(edges, nodes, n, kind)
    encode = fit_threshold(threshold, z, len(values))
    return encode(z), z, values.tolist()


def score_spectral(edges: DataFrame, codes: DataFrame, n: int, ranking: str = "ndcg") -> float:
    """Expected edges weighed anew by their codes, against their own weights."""
    both = graph.symmetric(edges.select("src", "dst", "weight"))
    got = hamming.pair_distances(hamming.create(codes), both.select("src", "dst"), n).select("src", "dst", (1 - F.col("dist")).alias("weight"))
    return metrics.score_retrieval(got, both, n, ranking).first().score


def tune_spectral(nodes: DataFrame, hoods: DataFrame, n: int, specs: dict[str, Any], rounds: int = 2, trials: int = 3, seed: int = 1) -> Found:
    """Searches knn, alpha, mode, Laplacian and threshold; graphs are memoised by their own parameters."""
    graphs: dict = {}

    def trial(p: dict) -> tuple[float, Any]:
        key = (p.get("knn", 8), p.get("knn_mode", "plain"), p.get("knn_alpha", 1.0))
        if key not in graphs:
            graphs[key] = build_adjacency(nodes, hoods, graph.Adjacency(knn=key[0], knn_mode=key[1], knn_alpha=key[2]))
        codes, z, values = build_spectral(nodes, graphs[key], n, p.get("kind", "normalized"), p.get("threshold", "median"))
        return score_spectral(graphs[key], codes, len(values)), (codes, z, values)

    return search(specs, trial, rounds, trials, seed=seed)


def tune_clauses(train: DataFrame, valid: DataFrame, base: clause_machine.Settings, specs: dict[str, Any], rounds: int = 2, trials: int = 3, iterations: int = 5, final_iterations: int = 20, patience: int = 10, seed: int = 1) -> Found:
    """Searches settings of a clause machine, then trains the best for longer with early stopping at its best epoch."""

    def score(model: clause_machine.Model) -> float:
        got = clause_machine.predict(valid, model)
        if base.kind == "classifier":
            rows = valid.select("id", F.col("label").cast("int").alias("expected")).join(got, "id")
            return metrics.macro(metrics.class_accuracy(rows, base.outputs)).first().f1
        rows = valid.select("id", "bits").join(got, "id").select(F.explode(F.arrays_zip("bits", "predicted")).alias("x"))
        return rows.agg(F.avg((F.col("x.bits") == F.col("x.predicted")).cast("double"))).first()[0] or 0.0

    def trial(p: dict) -> tuple[float, Any]:
        model = clause_machine.train(train, clause_machine.create(replace(base, **p)), iterations)
        return score(model), model

    def final(p: dict) -> tuple[float, Any]:
        best: list = [-1.0, None, 0]

        def each(epoch: int, model: clause_machine.Model) -> bool:
            s = score(model)
            if s > best[0]:
                best[:] = [s, model.checkpoint(), 0]
            else:
                best[2] += 1
            return best[2] < patience

        model = clause_machine.train(train, clause_machine.create(replace(base, **p)), final_iterations, each)
        model.restore(best[1])
        return best[0], model

    return search(specs, trial, rounds, trials, seed=seed, final=final)
