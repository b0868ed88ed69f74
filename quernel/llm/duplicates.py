"""Duplicates hidden by formatting differences.

Canonical records are range-partitioned by (field, hash of the key, id) and
sorted there by (field, hash, key, id), on disk where memory is short; one scan
compares the full keys of adjacent records. The hash keeps the sampled bounds
and most comparisons short; different keys with one hash stand side by side
and stay apart. A key's records may lie in several partitions, so a key that a
third of all records share is split like any other: only the first and last
keys of each partition, as a rule two rows, are compared across partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.canonical import question_key, statement_key
from quernel.workspace import materialise

KINDS: dict[str, Callable[[str | None], str | None]] = {"question": question_key, "statement": statement_key}
SCANNED = "part int, field string, id string, first_id string, lead boolean, edge_key string"
_OUT = pa.schema([("part", pa.int32()), ("field", pa.string()), ("id", pa.string()), ("first_id", pa.string()), ("lead", pa.bool_()), ("edge_key", pa.string())])
CACHE = 50_000


def _keys(kind: str):
    make = KINDS[kind]

    @F.pandas_udf("string")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen: dict[str, str | None] = {}
        for s in batches:
            out = []
            for text in s:
                if text is None:
                    out.append(None)
                    continue
                k = seen.get(text)
                if k is None:
                    k = make(text)
                    if len(seen) >= CACHE:
                        seen.clear()
                    seen[text] = k
                out.append(k)
            yield pd.Series(out, dtype=object)

    return keys


def canonical_records(df: DataFrame, record_id: str, fields: dict[str, str]) -> DataFrame:
    """field, key, id of every record's text in every field; ``fields`` gives the kind of each.

    Null texts equal nothing and are left out, as are records without an id.
    """
    out = None
    for name, kind in fields.items():
        rows = df.select(F.lit(name).alias("field"), F.col(f"`{name}`").alias("text"), F.col(f"`{record_id}`").alias("id"))
        rows = rows.where(F.col("text").isNotNull() & F.col("id").isNotNull()).select("field", _keys(kind)("text").alias("key"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of each run of equal keys with the run's first id; expects (field, hash, key, id) in order.

    ``lead`` marks members of the runs with the partition's first hash: earlier
    partitions may hold members with smaller ids. The key of these runs, and of
    those with the last hash, comes out with their first id as an edge.
    """
    part = TaskContext.get().partitionId()
    last: tuple | None = None  # field, hash, key, id of the row before
    first_id, lead, hashes = None, True, 0
    runs: list[tuple[str, str, str]] = []  # field, key, first id of the runs with the current hash
    for b in batches:
        field, h, key, ident = (b.column(i).to_pylist() for i in range(4))
        firsts, leads, edges, keep = [], [], [], []
        for i, (f, x, k, d) in enumerate(zip(field, h, key, ident, strict=True)):
            together = last is not None and x == last[1] and f == last[0]
            same = together and k == last[2]
            if same and d == last[3]:
                continue  # the record arrived again
            if not same:
                if not together:
                    hashes += 1
                    runs = []
                first_id, lead = d, hashes == 1
                runs.append((f, k, d))
            last = (f, x, k, d)
            keep.append(i)
            firsts.append(first_id)
            leads.append(lead)
            edges.append(k if hashes == 1 and not same else None)
        take = pa.array(np.array(keep, dtype=np.int64))
        n = len(keep)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, part, np.int32)), b.column(0).take(take).cast(pa.string()), b.column(3).take(take).cast(pa.string()), pa.array(firsts, pa.string()), pa.array(leads, pa.bool_()), pa.array(edges, pa.string())],
            schema=_OUT,
        )
    if hashes > 1:
        n = len(runs)
        fields, keys, ids = (list(x) for x in zip(*runs, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(fields, pa.string()), pa.array([None] * n, pa.string()), pa.array(ids, pa.string()), pa.array([False] * n), pa.array(keys, pa.string())], schema=_OUT)


def members(df: DataFrame, record_id: str, fields: dict[str, str]) -> DataFrame:
    """field, id, first_id: every record with the smallest id of all that have its key.

    Records that arrived repeatedly count once. An empty input gives no rows.
    """
    records = materialise(canonical_records(df, record_id, fields).select("field", F.xxhash64("key").alias("h"), "key", "id"), "canonical")
    ordered = records.repartitionByRange("field", "h", "id").sortWithinPartitions("field", "h", "key", "id")
    scanned = materialise(ordered.mapInArrow(_scan, SCANNED), "runs")
    edges = scanned.where(F.col("edge_key").isNotNull())
    names = edges.groupBy("field", F.col("edge_key")).agg(F.min("first_id").alias("name"))
    # As a rule one row for each partition, so its size is bounded by their number.
    carried = edges.where("lead").join(names, ["field", "edge_key"]).select("part", "field", "first_id", "name")
    rows = scanned.where(F.col("id").isNotNull())
    led = rows.where("lead").join(carried, ["part", "field", "first_id"]).select("field", "id", F.col("name").alias("first_id"))
    return rows.where(~F.col("lead")).select("field", "id", "first_id").unionByName(led)


def representatives(df: DataFrame, record_id: str, fields: dict[str, str]) -> DataFrame:
    """field, first_id, n_copies: one representative of each distinct text and its exact number of records."""
    return members(df, record_id, fields).groupBy("field", "first_id").agg(F.count(F.lit(1)).alias("n_copies"))
