"""Append-only sinks: the audit log and provenance events. Result rows are never written."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Keys that no event may hold.
PROHIBITED = {"rows", "result_rows", "password", "api_key", "secret", "token", "authorization"}

#: The log's fields: what was asked, what was decided and run, and how it went; lists and objects as JSON.
AUDIT = T.StructType(
    [T.StructField(n, T.StringType()) for n in "run_id actor connection_id question preset_id proposal_source model_decision model_reason_code model_detail runtime_outcome runtime_reason provider model proposed_sql executed_sql sql_changes follow_up_of edited_from columns model_context_hash trace".split()]
    + [T.StructField("row_count", T.IntegerType()), T.StructField("truncated", T.BooleanType()), T.StructField("duration_ms", T.DoubleType()), T.StructField("created_at", T.TimestampType())]
)


def append_run(spark: SparkSession, path: str, run: dict[str, Any]) -> None:
    """One run appended to the Parquet log; unknown and prohibited fields are refused."""
    bad = (set(run) & PROHIBITED) | (set(run) - set(AUDIT.names))
    if bad:
        raise ValueError(f"fields {sorted(bad)} don't belong in the log")
    row = {n: run.get(n) for n in AUDIT.names} | {"created_at": run.get("created_at") or datetime.now(timezone.utc).replace(tzinfo=None)}
    for n in ("sql_changes", "columns", "trace", "model_detail"):
        if row[n] is not None and not isinstance(row[n], str):
            row[n] = json.dumps(row[n])
    spark.createDataFrame([row], AUDIT).coalesce(1).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT).parquet(path)


def append_events(spark: SparkSession, path: str, events: list[dict[str, Any]]) -> list[str]:
    """Events appended as JSON lines, each with the hash of its content and of the one before; the hashes."""
    hashes, before, rows = [], "", []
    for e in events:
        found = _prohibited(e)
        if found:
            raise ValueError(f"an event may not hold {found}")
        body = json.dumps(e, sort_keys=True, separators=(",", ":"))
        before = hashlib.sha256((before + body).encode()).hexdigest()
        hashes.append(before)
        rows.append((body, before))
    spark.createDataFrame(rows, "body string, hash string").coalesce(1).write.mode("append").json(path)
    return hashes


def _prohibited(v: Any) -> str | None:
    if isinstance(v, dict):
        return next((k for k in v if k.lower() in PROHIBITED), None) or next((x for y in v.values() if (x := _prohibited(y))), None)
    if isinstance(v, list):
        return next((x for y in v if (x := _prohibited(y))), None)
    return None
