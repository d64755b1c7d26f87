"""Every query against its SQL on the small tables, and the entry without its optional part."""

import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from engramspark.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return None
        v = v.item() if hasattr(v, "item") else v
        if isinstance(v, float):
            v = round(v, 6)
            return int(v) if v.is_integer() else v
        return v if isinstance(v, int | str | bool) else str(v)

    return sorted(repr(tuple(map(one, r))) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = con.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_works_without_the_corpus_part(tmp_path):
    root = Path(__file__).resolve().parent.parent
    for p in root.iterdir():
        if p.name not in (".git", "corpus_pipeline.py", "engramspark"):
            os.symlink(p, tmp_path / p.name)
    (tmp_path / "engramspark").mkdir()
    for p in (root / "engramspark").iterdir():
        if p.name != "llm":
            os.symlink(p, tmp_path / "engramspark" / p.name)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(QUERIES)), str(len(ORACLE))]
