"""Total-correlation explanation: binary hidden factors that account for the dependence among sparse binary features.

A round scores all rows under the present parameters and sums what the next ones need; only hidden x visible sums leave a
task. Rows are (id, features).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMOOTH = 0.001


@dataclass
class Corex:
    visible: int
    hidden: int
    lam: float = 0.3
    spa: float = 10.0
    tmin: float = 1.0
    ttc: float = 500.0
    anchor: float = 0.0
    seed: int = 1

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        self.alpha = rng.uniform(0.5, 1.0, (self.hidden, self.visible))
        self.p_y = np.full(self.hidden, 0.5)
        self.p_xy = np.full((2, self.hidden, self.visible), 0.5)  # p(x = 1 | y)
        self.p_x = np.full(self.visible, 0.5)
        self.tcs = np.zeros(self.hidden)
        self.mi = np.zeros((self.hidden, self.visible))
        self.begun = False

    def _score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """p(y = 1 | x) [rows, hidden] and log z."""
        logs = []
        for y in (0, 1):
            on = np.log(self.p_xy[y]) - np.log(self.p_x)
            off = np.log1p(-self.p_xy[y]) - np.log1p(-self.p_x)
            logs.append(x @ (self.alpha * (on - off)).T + (self.alpha * off).sum(1) + np.log(self.p_y if y else 1 - self.p_y))
        z = np.logaddexp(logs[0], logs[1])
        return np.exp(logs[1] - z), z

    def _rows(self, sets: list) -> np.ndarray:
        x = np.zeros((len(sets), self.visible))
        for i, s in enumerate(sets):
            if s is not None and len(s):
                x[i, np.asarray(s, int)] = 1.0
        return x

    def _sums(self, rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
        me, begun = self, self.begun

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yx, y1, x1, n, tc = np.zeros((me.hidden, me.visible)), np.zeros(me.hidden), np.zeros(me.visible), 0.0, np.zeros(me.hidden)
            for pdf in batches:
                for lo in range(0, len(pdf), 1024):
                    part = pdf.iloc[lo : lo + 1024]
                    x = me._rows(part["features"].tolist())
                    if begun:
                        p, z = me._score(x)
                    else:
                        keys = pd.util.hash_array(part["id"].to_numpy().astype("int64"))
                        p, z = ((keys[:, None] >> (np.arange(me.hidden, dtype=np.uint64) % 53)) % 1024 / 1023.0), np.zeros((len(part), me.hidden))
                    yx += p.T @ x
                    y1 += p.sum(0)
                    x1 += x.sum(0)
                    n += len(part)
                    tc += z.sum(0)
            flat = np.r_[yx.ravel(), y1, x1, n, tc]
            yield pd.DataFrame({"p": np.arange(len(flat)), "v": flat})

        got = rows.select("id", "features").mapInPandas(run, "p long, v double").groupBy("p").agg(F.sum("v").alias("v")).toPandas().sort_values("p")["v"].to_numpy()
        h, v = self.hidden, self.visible
        return got[: h * v].reshape(h, v), got[h * v : h * v + h], got[h * v + h : h * v + h + v], float(got[h * v + h + v]), got[h * v + h + v + 1 :]

    def train(self, rows: DataFrame, iterations: int, each: Callable | None = None) -> "Corex":
        """``each(iteration, total correlation)`` sees every round; False stops."""
        for it in range(iterations):
            yx, y1, x1, n, tc = self._sums(rows)
            if not n:
                return self
            self.tcs = tc / n
            self.p_y = np.clip(y1 / n, SMOOTH, 1 - SMOOTH)
            self.p_x = (x1 + SMOOTH) / (n + 2 * SMOOTH)
            self.p_xy[1] = (yx + SMOOTH * self.p_x) / (y1[:, None] + SMOOTH)
            self.p_xy[0] = (x1 - yx + SMOOTH * self.p_x) / (n - y1[:, None] + SMOOTH)
            self.p_xy = np.clip(self.p_xy, 1e-9, 1 - 1e-9)
            mi = np.zeros_like(self.mi)
            for y, py in ((0, 1 - self.p_y), (1, self.p_y)):
                p = self.p_xy[y]
                mi += py[:, None] * (p * np.log(p / self.p_x) + (1 - p) * np.log((1 - p) / (1 - self.p_x)))
            entropy = np.maximum(1e-4, -(self.p_x * np.log(self.p_x) + (1 - self.p_x) * np.log(1 - self.p_x)))
            self.mi = np.maximum(0, mi) / entropy
            if self.anchor:  # the last visibles are the hidden factors' anchors
                a = np.arange(self.hidden)
                self.mi[a, self.visible - self.hidden + a] = self.anchor
            t = np.maximum(self.tmin, self.ttc * np.abs(self.tcs))[:, None] / self.spa
            new = np.exp(np.minimum(0.0, t * (self.mi - self.mi.max(0))))
            self.alpha = (1 - self.lam) * self.alpha + self.lam * new
            self.begun = True
            if each and each(it, float(self.tcs.sum())) is False:
                break
        return self

    def compress(self, rows: DataFrame) -> DataFrame:
        """(id, bit) of the hidden factors with p(y = 0 | x) under a half."""
        me = self
        kind = dict(rows.dtypes)["id"]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                p, _ = me._score(me._rows(pdf["features"].tolist()))
                i, h = np.nonzero(1 - p < 0.5)
                yield pd.DataFrame({"id": pdf["id"].to_numpy()[i], "bit": h})

        return rows.select("id", "features").mapInPandas(run, f"id {kind}, bit long")

    def top_visible(self, k: int) -> list[list[int]]:
        """The k features of most weighted information, of each hidden factor."""
        s = self.alpha * self.mi
        return [np.lexsort((np.arange(self.visible), -row))[:k].tolist() for row in s]
