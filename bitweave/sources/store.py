"""Persisted objects: a folder of parquet tables and a JSON line of parameters; models of arrays as one table of bytes."""

from __future__ import annotations

import json
from dataclasses import asdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def persist(spark: SparkSession, path: str, tables: dict[str, DataFrame], params: dict | None = None) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps({"tables": sorted(tables), "params": params or {}}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    about = json.loads(spark.read.text(f"{path}/about").first().value)
    return {t: spark.read.parquet(f"{path}/{t}") for t in about["tables"]}, about["params"]


def to_text(tables: dict[str, DataFrame], params: dict | None = None) -> str:
    """Small objects as a string, in place of a path."""
    return json.dumps({"params": params or {}, "tables": {k: {"schema": json.loads(d.schema.json()), "rows": [r.asDict(recursive=True) for r in d.collect()]} for k, d in tables.items()}})


def from_text(spark: SparkSession, text: str) -> tuple[dict[str, DataFrame], dict]:
    from pyspark.sql.types import StructType

    got = json.loads(text)
    out = {}
    for k, t in got["tables"].items():
        schema = StructType.fromJson(t["schema"])
        out[k] = spark.createDataFrame([tuple(r.get(n) for n in schema.names) for r in t["rows"]], schema)
    return out, got["params"]


def _arrays(spark: SparkSession, arrays: dict[str, np.ndarray]) -> DataFrame:
    return spark.createDataFrame([(k, str(v.dtype), list(v.shape), bytearray(np.ascontiguousarray(v).tobytes())) for k, v in arrays.items()], "name string, dtype string, shape array<int>, data binary")


def _read(df: DataFrame) -> dict[str, np.ndarray]:
    return {r["name"]: np.frombuffer(bytes(r["data"]), r["dtype"]).reshape(r["shape"]).copy() for r in df.collect()}


def persist_clauses(spark: SparkSession, path: str, model) -> None:
    persist(spark, path, {"state": _arrays(spark, {"state": model.state})}, asdict(model.settings))


def load_clauses(spark: SparkSession, path: str):
    from bitweave.operators.clause_machine import Model, Settings

    tables, params = load(spark, path)
    return Model(Settings(**params), _read(tables["state"])["state"])


def persist_corex(spark: SparkSession, path: str, m) -> None:
    names = ("alpha", "p_y", "p_xy", "p_x", "tcs", "mi")
    persist(spark, path, {"state": _arrays(spark, {n: getattr(m, n) for n in names})}, {k: getattr(m, k) for k in ("visible", "hidden", "lam", "spa", "tmin", "ttc", "anchor", "seed", "begun")})


def load_corex(spark: SparkSession, path: str):
    from bitweave.operators.corex import Corex

    tables, params = load(spark, path)
    begun = params.pop("begun")
    m = Corex(**params)
    for k, v in _read(tables["state"]).items():
        setattr(m, k, v)
    m.begun = begun
    return m


def persist_booleanizer(spark: SparkSession, path: str, bits: DataFrame, config) -> None:
    persist(spark, path, {"bits": bits}, asdict(config))


def load_booleanizer(spark: SparkSession, path: str):
    from bitweave.operators.booleanizer import Booleanizer

    tables, params = load(spark, path)
    return tables["bits"], Booleanizer(params["n_thresholds"], tuple(params["continuous"]), tuple(params["categorical"]))
