from pyspark.sql import functions as F

from bitweave.functions import similarity, text
from bitweave.operators import booleanizer as bz
from bitweave.operators import selection
from bitweave.sources import datasets, store


def eav(spark, rows):
    return spark.createDataFrame(rows, "id long, attr string, value_str string, value_num double")


def test_thresholds_by_hand(spark):
    v = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 7, 8)] + [("b", 5.0)], "attr string, v double")
    t = lambda n: sorted((r.attr, r.threshold) for r in bz.thresholds(v, n).collect())
    assert t(0) == [("a", 5.0), ("b", 5.0)]
    assert t(5) == [("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 7.0), ("a", 8.0), ("b", 5.0)]
    assert t(1) == [("a", 3.0), ("b", 5.0)]


def test_eav_encode(spark):
    rows = [(1, "title", "x", None), (2, "title", "y", None), (1, "year", None, 1990.0), (2, "year", None, 2000.0), (3, "year", None, 2010.0), (3, "title", None, None)]
    b = bz.Booleanizer(n_thresholds=2).fit(eav(spark, rows))
    table = {r.bit: (r.attr, r.kind, r.value_str, r.threshold) for r in b.collect()}
    assert len(table) == 4 and sorted(table) == [0, 1, 2, 3]
    got = {(r.id, table[r.bit][0], table[r.bit][2] or round(table[r.bit][3], 3)) for r in bz.encode(eav(spark, rows), b).collect()}
    assert got == {(1, "title", "x"), (2, "title", "y"), (2, "year", 1996.667), (3, "year", 1996.667), (3, "year", 2003.333)}
    assert bz.features(b).first()[0] == 4 and bz.feature(b, "title", "y").first().bit == 1
    r = bz.restrict(b, ["year"])
    assert sorted(x.bit for x in r.collect()) == [0, 1]
    assert bz.index(b).count() == 4
    assert bz.encode(eav(spark, [(9, "title", "unseen", None)]), b).count() == 0


def test_matrix_is_inclusive(spark):
    m = spark.createDataFrame([(i, [float(i * 3 + j + 1) for j in range(3)]) for i in range(3)], "id long, embedding array<double>")
    rows = bz.matrix(m, "id", "embedding")
    b = bz.Booleanizer(n_thresholds=1).fit(rows)
    n = lambda inc: bz.encode(rows, b, inclusive=inc).count()
    assert n(True) == 6 and n(False) == 3


def test_chi2_mi_and_idf(spark):
    bits = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (1, "c"), (3, "c")], "id long, feature string")
    lab = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0)], "id long, label int")
    t = selection.contingency(bits, lab)
    chi = {(r.feature, r.label): round(r.score, 6) for r in selection.chi2(t).collect()}
    assert chi["a", 1] == 4.0 and chi["c", 1] == 0.0
    mi = {(r.feature, r.label): round(r.score, 6) for r in selection.mutual_information(t).collect()}
    assert mi["a", 1] == 0.693147 and mi["c", 0] == 0.0
    assert [r.feature for r in selection.top(selection.chi2(t), 2).orderBy("rank").collect()] == ["a", "b"]
    df = {r.feature: round(r.idf, 6) for r in selection.document_frequency(bits, 4).collect()}
    assert df == {"a": 0.693147, "b": 0.693147, "c": 0.693147}
    assert selection.top_per_label(selection.chi2(t), 1).count() == 2


def test_cleaning_and_tokens(spark):
    raw = "From: a@b.org\nSubject: x\n\nHello world\n> quoted\n  : also\nmail me at joe@x.com or www.site.edu now\n--\nsig"
    got = spark.createDataFrame([(raw,), (None,)], "t string").select(text.clean_posting(F.col("t"))).collect()
    assert got[0][0].split() == ["Hello", "world", "mail", "me", "at", "or", "now"] and got[1][0] is None
    t = spark.createDataFrame([("The cat the Dog",)], "t string").select(text.tokens(F.col("t"), ngram=2, chars=(3,), skips=1)).first()[0]
    assert {"the", "cat", "dog", "the cat", "cat the", "the the", "#cat"} <= set(t)


def test_blend_and_rank_weights(spark):
    r = spark.range(1).select(similarity.blend(F.lit(0.5), F.lit(1.0), [1.0]).alias("a"), similarity.rank_weight(F.lit(1), -1.0, 3).alias("b")).first()
    assert abs(r.a - (1 - (0.5 + 0.5) / 1.5)) < 1e-12 and abs(r.b - 2.718281828 ** -1.0) < 1e-6


def test_sources_and_split(spark, tmp_path):
    (tmp_path / "m.txt").write_text("1 0 1 4\n0 1 0 2\n\n1 1 1 9\n")
    rows = datasets.binary_matrix(spark, str(tmp_path / "m.txt"), 3).orderBy("id").collect()
    assert [(r.features, r.label) for r in rows] == [([0, 2], 4), ([1], 2), ([0, 1, 2], 9)]
    for c in ("pos", "neg"):
        (tmp_path / "imdb" / c).mkdir(parents=True)
        for i in range(3):
            (tmp_path / "imdb" / c / f"{i}.txt").write_text(f"{c} {i}")
    d = datasets.text_folders(spark, str(tmp_path / "imdb"), {"pos": 1, "neg": 0}, most=2).collect()
    assert len(d) == 4 and all((r.label == 1) == r.text.startswith("pos") for r in d)
    s = datasets.split(spark.range(10), 0.75, 0.5).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in s} == {"train": 4, "validate": 3, "test": 3}
    ci = datasets.classes_index(spark.createDataFrame([(1, "z"), (2, "a"), (3, "z")], "id long, class string"))
    assert {r.id: r.feature for r in ci.collect()} == {1: 0, 2: 1, 3: 0}


def test_persist_and_load(spark, tmp_path):
    d = spark.createDataFrame([(1, [1, 2])], "id long, code array<bigint>")
    store.persist(spark, str(tmp_path / "x"), {"codes": d}, {"n": 64})
    tables, params = store.load(spark, str(tmp_path / "x"))
    assert tables["codes"].collect() == d.collect() and params == {"n": 64}
    tables, params = store.from_text(spark, store.to_text({"codes": d}, {"n": 1}))
    assert tables["codes"].collect() == d.collect()


def test_sets_are_labelled_before_they_are_taken_apart(spark):
    bits = [(1, "a"), (2, "a"), (3, "b"), (4, "b"), (1, "c"), (3, "c"), (9, "z")]
    lab = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0), (4, 1), (7, 0), (1, None)], "id long, label int")
    sets = spark.createDataFrame([(i, [f for j, f in bits if j == i]) for i in (1, 2, 3, 4, 9)] + [(7, [])], "id long, features array<string>")
    whole = selection.contingency(spark.createDataFrame(bits + bits[:2], "id long, feature string"), lab)
    apart = selection.contingency(sets, lab)
    key = lambda t: sorted(tuple(r) for r in t.select("feature", "label", "n11", "n1x", "nx1", "n").collect())
    assert key(apart) == key(whole) and ("a", 0, 0, 2, 3, 6) in key(apart) and len(key(apart)) == 6
    assert "join" not in apart._jdf.queryExecution().optimizedPlan().toString().lower().split("generate")[1].split("\n")[0]
    none = selection.contingency(sets, lab.where("false"))
    assert none.count() == 0 and none.columns == apart.columns


def test_simhash_of_sets(spark, monkeypatch):
    from bitweave.operators import setjoin, simhash

    monkeypatch.setattr(simhash, "TAKEN", 4)
    rows = {i: [f"w{j * i % 17}é" for j in range(i % 7)] for i in range(30)}
    sets = spark.createDataFrame([(i, sorted(set(f))) for i, f in rows.items()], "id long, features array<string>")
    bits = spark.createDataFrame([(i, x) for i, f in rows.items() for x in f], "id long, feature string")
    for n in (16, 40):
        got = {r.id: list(r.code) for r in simhash.encode_sets(sets, n).collect()}
        assert got == {r.id: list(r.code) for r in simhash.encode(setjoin.create(bits), n).collect()} and got
        assert "Exchange" not in simhash.encode_sets(sets, n)._jdf.queryExecution().executedPlan().toString()


def test_bits_join_by_value_not_by_attribute(spark):
    from bitweave.operators import booleanizer

    rows = spark.createDataFrame([(i, "c", f"v{i % 3}", None) for i in range(30)] + [(i, "x", None, float(i)) for i in range(30)], "id long, attr string, value_str string, value_num double")
    b = booleanizer.Booleanizer(n_thresholds=3).fit(rows)
    plan = booleanizer.encode(rows, b)._jdf.queryExecution().optimizedPlan().toString()
    keys = [x for x in plan.split("\n") if "Join Inner" in x]
    assert any("_t" in x and "attr" in x for x in keys) and any("strategy=broadcast" in x for x in keys)
    assert booleanizer.encode(rows, b).count() == 30 + 22 + 15 + 8
