"""Every registered query of the engine against its DuckDB twin, on the smallest driver tables."""

import glob
import math
import os

import pytest

from seqspark.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = sorted(tuple(_norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
    assert rows
    if name in ORACLE:
        r = duck.execute(ORACLE[name])
        cols = [c[0] for c in r.description]
        assert sorted(cols) == sorted(df.columns)
        order = [cols.index(c) for c in sorted(cols)]
        assert rows == sorted(tuple(_norm(x[i]) for i in order) for x in r.fetchall())
