"""The entry point, the catalogue against its SQL, and the optional text operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")
CATALOGUE = [n for n in __spark_entry__.queries() if n in __spark_entry__.oracle_sql() and not (n.startswith("op") and n[2].isdigit())]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return "-"
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else repr(round(v, 9))
    return str(v)


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(plain(v) for v in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", CATALOGUE)
def test_query_equals_its_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, str(DATA)).toPandas()
    want = duck.sql(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_without_the_text_operators(tmp_path):
    for item in ("__spark_entry__.py", "tidegate"):
        at = ROOT / item
        shutil.copytree(at, tmp_path / item, ignore=shutil.ignore_patterns("llm", "__pycache__")) if at.is_dir() else shutil.copy(at, tmp_path / item)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'gain_double' in q and 'pipeline' not in q and not any(n[:2] == 'op' and n[2].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
