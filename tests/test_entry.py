import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_names_agree():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 40


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["binarize_sign", "hamming_topk", "jaccard_topk", "bool_encode_eav", "graph_components", "class_accuracy"])
def test_against_duckdb(spark, name):
    import duckdb

    q, o = entry.queries(), entry.oracle_sql()
    c = duckdb.connect()
    for t in "customer documents embeddings benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.execute(o[name]).df()
    got = q[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    key = lambda d: sorted(tuple(round(x, 6) if isinstance(x, float) else str(x) for x in r) for r in d[cols].itertuples(index=False))
    assert key(got) == key(want)


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_subpackage(tmp_path, pipeline):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "bitweave", tmp_path / "bitweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    if pipeline and (root / "corpus_pipeline.py").exists():
        shutil.copy(root / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), 'pipeline' in q, any(k.startswith('op') and k[2].isdigit() for k in q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**__import__("os").environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    n, m, *rest = said.stdout.split()
    assert int(n) > 50 and int(m) > 40 and rest == ["False", "False"], said.stderr


def test_only_own_tables_are_swept(spark):
    from bitweave.session import Staging, stage

    before = stage(spark.range(5), "before")
    with Staging(spark) as own:
        a, b = stage(spark.range(7), "a"), stage(spark.range(9), "b")
        with Staging(spark) as inner:
            c = stage(spark.range(3), "c")
    own.sweep(b)
    assert (before.count(), b.count(), c.count()) == (5, 9, 3) and len(own.paths) == len(inner.paths) == 1
    with pytest.raises(Exception):
        a.count()
