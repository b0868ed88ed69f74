"""The text and record queries on tables without rows, and on rows in which everything is null."""

import pytest

from quernel.llm.queries import QUERIES

TABLES = ("audit_runs", "reports", "report_snapshots", "documents", "subject_areas", "subject_labels")


@pytest.fixture(scope="module")
def hollow(spark, sf, tmp_path_factory):
    out = {}
    for kind in ("empty", "nulls"):
        base = tmp_path_factory.mktemp(kind)
        for t in TABLES:
            df = spark.read.parquet(f"{sf}/{t}.parquet")
            rows = [] if kind == "empty" else [tuple([None] * len(df.columns))] * 3
            spark.createDataFrame(rows, df.schema).write.parquet(f"{base}/{t}.parquet")
        out[kind] = str(base)
    return out


@pytest.mark.parametrize("kind", ["empty", "nulls"])
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, hollow, kind, name):
    rows = QUERIES[name](spark, hollow[kind]).collect()
    if name.endswith("_found"):
        assert rows == []
    if name == "p8_ids":
        assert [list(r["ids"]) for r in rows] == ([] if kind == "empty" else [[]] * 3)
