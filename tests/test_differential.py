"""Every query that has SQL gives the rows that DuckDB gives on the same tables."""

import datetime as dt
import decimal
import glob
import importlib
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

MODULES = [importlib.import_module(f"quernel.queries.{n}") for n in ("corpus", "relational", "governance", "profiling", "operations")]
CASES = [(n, m) for m in MODULES for n in m.QUERIES if n in m.SQL and n not in ("gate_verdicts", "grain_verdicts", "surface_admitted")]


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.8g}"
    if isinstance(v, dt.datetime):
        return v.isoformat(" ")
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize(("name", "module"), CASES, ids=[n for n, _ in CASES])
def test_equals_duckdb(spark, sf, duck, name, module):
    df = module.QUERIES[name](spark, sf)
    rel = duck.execute(module.SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, rel.fetchall())
