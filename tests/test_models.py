import numpy as np
import pytest

from bitweave.operators import clause_machine as cm
from bitweave.operators.corex import Corex
from bitweave.plans import search
from bitweave.sources import store
from bitweave.streaming.upsert import IndexTable, follow


def xor_like(spark, n=300):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (n, 6))
    return spark.createDataFrame([(i, [int(f) for f in np.flatnonzero(r)], int(r[0] ^ r[1])) for i, r in enumerate(x)], "id long, features array<int>, label int")


def test_votes_by_hand():
    inc = np.array([[True, False, False, True], [False] * 4])
    x = np.array([[True, False, False, True], [False, False, True, True]])
    assert cm.clause_votes(inc, x, 3).tolist() == [[2, 3], [1, 3]]


def test_classifier_learns_and_persists(spark, tmp_path):
    rows = xor_like(spark)
    model = cm.train(rows, cm.create(cm.Settings("classifier", 2, 6, clauses=16, clause_tolerance=4, specificity=3.0, negative=1.0)), 15)
    got = {r.id: r.predicted for r in cm.predict(rows, model).collect()}
    want = {r.id: r.label for r in rows.collect()}
    acc = np.mean([got[i] == want[i] for i in want])
    assert acc > 0.9
    store.persist_clauses(spark, str(tmp_path / "m"), model)
    again = store.load_clauses(spark, str(tmp_path / "m"))
    assert (again.state == model.state).all()
    acts = model.checkpoint()
    fresh = cm.create(model.settings)
    fresh.restore(acts)
    assert (fresh.included() == model.included()).all()
    assert model.restrict([1]).settings.outputs == 1
    with pytest.raises(ValueError):
        model.restrict([0, 0])


def test_encoder_and_search(spark):
    rows = xor_like(spark, 120)
    enc = rows.selectExpr("id", "features", "array(cast(array_contains(features, 0) as int), cast(array_contains(features, 1) as int)) as bits")
    model = cm.train(enc, cm.create(cm.Settings("encoder", 2, 6, clauses=8, clause_tolerance=4, specificity=3.0)), 5)
    got = cm.predict(enc, model).join(enc.select("id", "bits"), "id").collect()
    assert np.mean([r.predicted == r.bits for r in got]) > 0.8
    f = search.search({"x": {"low": 0.0, "high": 1.0}, "y": 3}, lambda p: (-((p["x"] - 0.3) ** 2), None), rounds=4, trials=12)
    assert abs(f.params["x"] - 0.3) < 0.15 and f.params["y"] == 3
    assert search.success_factor(0.3) == 1.0 and search.success_factor(0.1) == 0.8 and search.success_factor(0.0) == 0.5
    assert search.build_sampler({"low": 2, "high": 64, "pow2": True}).draw(__import__("random").Random(1)) in {2, 4, 8, 16, 32, 64}
    tuned = search.tune_clauses(rows, rows, cm.Settings("classifier", 2, 6, clauses=8, clause_tolerance=4, negative=1.0), {"specificity": [3.0]}, 1, 1, 3, 4)
    assert tuned.score > 0.5


def test_corex_groups_features(spark, tmp_path):
    rng = np.random.default_rng(2)
    z = rng.integers(0, 2, (400, 2))
    x = np.repeat(z, 3, axis=1)
    rows = spark.createDataFrame([(i, [int(f) for f in np.flatnonzero(r)]) for i, r in enumerate(x)], "id long, features array<int>")
    m = Corex(6, 2, seed=3).train(rows, 30)
    groups = {frozenset(t) for t in m.top_visible(3)}
    assert groups <= {frozenset({0, 1, 2}), frozenset({3, 4, 5})} | groups and m.tcs.sum() > 0.5
    assert m.compress(rows).count() > 0
    store.persist_corex(spark, str(tmp_path / "c"), m)
    assert np.allclose(store.load_corex(spark, str(tmp_path / "c")).alpha, m.alpha)


def test_stream_upserts(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, 0, 5), (2, 0, 6)], "id long, v long, code long").coalesce(1).write.parquet(str(src))
    table = IndexTable(spark, str(tmp_path / "ix"))
    run = lambda: follow(spark.readStream.schema("id long, v long, code long").parquet(str(src)), table, "v", str(tmp_path / "cp")).awaitTermination()
    run()
    spark.createDataFrame([(1, 1, 9)], "id long, v long, code long").coalesce(1).write.mode("append").parquet(str(src))
    run()
    assert {r.id: r.code for r in table.read().collect()} == {1: 9, 2: 6}


def test_spectral_pipeline(spark):
    from pyspark.sql import functions as F

    from bitweave.operators import setjoin

    d = spark.createDataFrame([(i, j, 0.1 if (i < 6) == (j < 6) else 0.9) for i in range(12) for j in range(12) if i != j], "src long, dst long, dist double")
    hoods = setjoin.best(d, 4)
    nodes = spark.range(12)
    edges = search.build_adjacency(nodes, hoods, search.graph.Adjacency(knn=3))
    codes, z, values = search.build_spectral(nodes, edges, 2)
    got = {r.id: r.b for r in codes.select("id", F.col("code")[0].bitwiseAND(F.lit(1)).alias("b")).collect()}
    assert len({got[i] for i in range(6)}) == 1 and got[0] != got[11]
    assert 0 <= search.score_spectral(edges, codes, len(values)) <= 1
