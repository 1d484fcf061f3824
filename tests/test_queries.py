"""Every query with an oracle gives the same rows as DuckDB, on the small tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillon import catalog

SF = "/root/testdata/sf0.001"
NAMES = sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 4) + 0.0
    return str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(norm(r[c]) for c in columns)) for r in df.collect())
    out = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(norm(r[names.index(c)]) for c in columns)) for r in out.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(NAMES)))
def test_without_oracle_runs(spark, name):
    df = catalog.queries()[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
