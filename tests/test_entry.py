import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as e
from readpool import registry

DATA = "/root/testdata/sf0.001"
SLOW = {"stage1_chunks", "stage3_clusters", "full_run", "run_report"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_oracles_have_queries():
    assert set(e.oracle_sql()) <= set(e.queries()) and set(registry.queries()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_flagship(spark):
    assert e.entry(spark).columns == ["a", "b", "mult", "sd", "accepted"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - SLOW))
def test_query_against_sql(spark, name):
    import duckdb

    got = registry.queries()[name](spark, DATA).toPandas()
    if name not in registry.oracle_sql():
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    as_rows = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).values.tolist()))
    assert as_rows(got) == as_rows(want)


def test_the_rest_works_without_the_subpackage(tmp_path):
    """A copy without the operators of training-data pipelines has its own queries, and its tests can be run."""
    root = Path(e.__file__).resolve().parent
    for p in [root / "__spark_entry__.py", *root.glob("readpool/**/*.py"), *root.glob("tests/**/*.py")]:
        if "llm" not in p.relative_to(root).parts:
            to = tmp_path / p.relative_to(root)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_bytes(p.read_bytes())
    code = "import __spark_entry__ as e; assert len(e.queries()) > 30 and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    run = [sys.executable, "-m", "pytest", "-q", "-x", "tests/test_sequences.py", "-k", "not query_against", "-p", "no:cacheprovider"]
    subprocess.run(run, cwd=tmp_path, check=True)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "--collect-only", "-p", "no:cacheprovider"], cwd=tmp_path, check=True)
