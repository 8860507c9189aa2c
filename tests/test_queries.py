"""Every registered query runs on the smallest tables and equals its SQL twin where it has one."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from foliospark.plans import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def value(v):
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    try:
        return repr(float(f"{float(v):.9g}"))
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(value(v) for v in r) for r in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, sf_dir, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql:
        assert rows(got) == rows(duck.sql(sql).df())
    else:
        assert len(got) > 0


def test_equal_intervals_merge_the_same_way(spark, tmp_path):
    """Of equal intervals that begin a merged one any may come first: query and twin count all of them into it."""
    con = duckdb.connect()
    con.sql(f"""COPY (SELECT k AS l_orderkey, q AS l_quantity, 1 AS l_linenumber FROM range(200000) a(k), (VALUES (1.0), (20.0), (20.0), (20.0), (22.0), (40.0), (40.0)) b(q))
        TO '{tmp_path}/lineitem.parquet'""")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = {(1.0, 2.0, 1): 200_000, (20.0, 23.0, 4): 200_000, (40.0, 41.0, 2): 200_000}
    twin = registry.oracle_sql()["win10_merged_intervals"]
    for _ in range(3):
        assert {tuple(r[:3]): r[3] for r in con.sql(f"SELECT a, b, n, count(*) FROM ({twin}) GROUP BY ALL").fetchall()} == want
    got = registry.queries()["win10_merged_intervals"](spark, str(tmp_path)).groupBy("a", "b", "n").count().collect()
    assert {tuple(r[:3]): r[3] for r in got} == want


def test_entry_works_without_optional_parts(tmp_path):
    """The entry point imports when the training-data folders are gone."""
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{here}/foliospark", tmp_path / "foliospark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert not any(k.startswith('op') or k == 'pipeline' for k in q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) > 100
