"""Running admitted plans: tickets, time limit, bounded rows, error classes."""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass, field
from itertools import count
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quernel.plans.parse import quiet

MAX_ROWS = 1000
TIMEOUT_S = 5.0
CANCEL_EVERY_S = 0.2

# Spark's error conditions (and words of its messages) by error class.
CLASSES = {
    "CAST_INVALID_INPUT": "INVALID_TEXT_CONVERSION",
    "INVALID_PARAMETER_VALUE": "INVALID_PARAMETER",
    "DIVIDE_BY_ZERO": "DIVISION_BY_ZERO",
    "ARITHMETIC_OVERFLOW": "NUMERIC_OVERFLOW",
    "NUMERIC_VALUE_OUT_OF_RANGE": "NUMERIC_OVERFLOW",
    "CAST_OVERFLOW": "NUMERIC_OVERFLOW",
    "DATATYPE_MISMATCH": "TYPE_MISMATCH",
    "CANNOT_PARSE_TIMESTAMP": "INVALID_DATETIME",
    "DATETIME_FIELD_OUT_OF_BOUNDS": "INVALID_DATETIME",
    "SCALAR_SUBQUERY_TOO_MANY_ROWS": "MULTIPLE_SUBQUERY_ROWS",
    "UNRESOLVED_COLUMN": "UNKNOWN_COLUMN",
    "MISSING_AGGREGATION": "GROUPING_ERROR",
    "UNRESOLVED_ROUTINE": "UNKNOWN_FUNCTION",
    "cancelled": "STATEMENT_TIMEOUT",
    "canceled": "STATEMENT_TIMEOUT",
}


def unique_names(names: list[str]) -> list[str]:
    """Output names that Spark's resolver, which knows no letter case, tells apart.

    Every name stays with the first column that has it; a later one gets the
    first number from 2 on that makes it another than all names given or made.
    """
    owner = {n.lower(): i for i, n in reversed(list(enumerate(names)))}
    out = list(names)
    for i, n in enumerate(names):
        if owner[n.lower()] != i:
            out[i] = next(c for k in count(2) if (c := f"{n}_{k}").lower() not in owner)
            owner[out[i].lower()] = i
    return out


def error_class(error: BaseException) -> str:
    """The class of an error raised while a query runs."""
    condition = getattr(error, "getCondition", lambda: None)() or ""
    text = f"{condition} {error}"
    java = getattr(error, "java_exception", None)
    while java is not None:
        text += " " + str(java.toString())
        java = java.getCause()
    for key, name in CLASSES.items():
        if condition.startswith(key):
            return name
    return next((name for key, name in CLASSES.items() if key in text), "EXECUTION_ERROR")


@dataclass
class Result:
    columns: list[str]
    rows: list[dict[str, Any]]
    truncated: bool
    latency_ms: float
    row_count: int = 0
    session_timezone: str = "UTC"


class ExecutionError(Exception):
    def __init__(self, kind: str, message: str) -> None:
        super().__init__(message)
        self.kind = kind


@dataclass
class Tickets:
    """Only the very object that planning issued may run, once issued by this service."""

    issued: dict[int, Any] = field(default_factory=dict)

    def issue(self, plan: Any) -> Any:
        self.issued[id(plan)] = plan
        return plan

    def check(self, plan: Any) -> None:
        if self.issued.get(id(plan)) is not plan:
            raise ExecutionError("PLAN_NOT_ISSUED", "the plan was not issued here")


def run_bounded(spark: SparkSession, df: DataFrame, max_rows: int = MAX_ROWS, timeout_s: float = TIMEOUT_S) -> Result:
    """At most ``max_rows`` rows, fetched with one more to tell whether there are others, within a time limit."""
    names = unique_names(df.columns)
    tag = f"quernel-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    began = time.monotonic()
    ended = threading.Event()

    def watch() -> None:
        """Cancels what runs after the limit, again and again: a query is several jobs, one after the other."""
        wait = timeout_s
        while not ended.wait(wait):
            sc.cancelJobsWithTag(tag)
            wait = CANCEL_EVERY_S

    sc.addJobTag(tag)
    threading.Thread(target=watch, daemon=True).start()
    try:
        with quiet():
            rows = df.limit(max_rows + 1).collect()
    except Exception as e:  # noqa: BLE001
        late = time.monotonic() - began >= timeout_s
        raise ExecutionError("STATEMENT_TIMEOUT" if late else error_class(e), str(e).split("\n")[0]) from e
    finally:
        ended.set()
        sc.removeJobTag(tag)
    kept = [dict(zip(names, r, strict=True)) for r in rows[:max_rows]]
    return Result(names, kept, len(rows) > max_rows, (time.monotonic() - began) * 1000, len(kept), spark.conf.get("spark.sql.session.timeZone"))
