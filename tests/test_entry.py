"""Every registered query against its SQL, on the smallest tables."""

import os

import __spark_entry__ as e
import duckdb
import pandas as pd
import pytest
from lectern.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    cols = sorted(df.columns)
    df = df[cols].copy()
    for c in cols:
        if pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].round(6)
    return sorted(map(str, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


def test_entry(spark):
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    if name in registry.SQL:
        want = duck.execute(registry.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got) or not os.path.exists(sf_dir)


def test_rest_works_without_the_llm_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(e.__file__).parent
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    assert (tmp_path / "repo" / "corpus_pipeline.py").exists() == (root / "corpus_pipeline.py").exists()
    code = "import __spark_entry__ as e; print(sorted(e.queries())[:3], any(q.startswith('op') for q in e.queries()), len(e.oracle_sql()))"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True)
    assert got.returncode == 0 and "False" in got.stdout, got.stderr
