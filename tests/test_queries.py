"""Every registered query outside the optional subpackage runs, and agrees with its SQL."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry  # registers all queries
from skyloom.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf, tmp_path_factory):
    con = duckdb.connect(config={"temp_directory": str(tmp_path_factory.mktemp("duckdb")), "max_temp_directory_size": "4GB"})
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name in ORACLE_SQL:
        rel = duck.sql(ORACLE_SQL[name])
        assert sorted(rel.columns) == columns
        want = [tuple(plain(dict(zip(rel.columns, r, strict=True))[c]) for c in columns) for r in rel.fetchall()]
        key = lambda r: tuple((x is None, str(x)) for x in r)
        assert sorted(rows, key=key) == sorted(want, key=key)


def test_entry(spark):
    assert entry.entry(spark).columns == ["region_id", "source_id", "pm", "deviation"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
