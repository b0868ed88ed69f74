"""From an untrusted text to admitted rows: the gates in order, each with a trace stage."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.catalog import Catalog
from quernel.plans import cost, grain, policy, rewrite
from quernel.plans.execute import MAX_ROWS, TIMEOUT_S, ExecutionError, Result, Tickets, run_bounded
from quernel.plans.parse import ParseFailure


@dataclass
class QueryPlan:
    plan_id: str
    sql: str
    df: DataFrame
    tables: list[str]
    columns: list[tuple[str, str]]
    functions: list[str]
    changes: list[str]
    unmatched: list[tuple[str, str]]
    estimate: cost.Estimate


@dataclass
class Refusal:
    stage: str
    code: str
    message: str


@dataclass
class Trace:
    stages: list[dict[str, Any]] = field(default_factory=list)
    #: Called with each stage as it ends, for showing progress.
    listener: Callable[[dict[str, Any]], None] | None = None

    def add(self, name: str, status: str, began: float, reason: str | None = None) -> None:
        self.stages.append({"name": name, "status": status, "duration_ms": round((time.monotonic() - began) * 1000, 3), "reason": reason})
        if self.listener:
            self.listener(self.stages[-1])


class GovernedSql:
    """Plans and runs queries over registered views of one catalog."""

    def __init__(self, spark: SparkSession, catalog: Catalog, max_rows: int = MAX_ROWS, timeout_s: float = TIMEOUT_S, max_plan_rows: float = cost.MAX_ROWS, max_plan_cost: float = cost.MAX_COST) -> None:
        self.spark, self.catalog = spark, catalog
        self.max_rows, self.timeout_s = max_rows, timeout_s
        self.max_plan_rows, self.max_plan_cost = max_plan_rows, max_plan_cost
        self.tickets = Tickets()
        self.trace = Trace()
        self._counts: dict[str, float] = {}
        self._values: dict[tuple[str, str], float] = {}

    def row_counts(self, tables: list[str]) -> dict[str, float]:
        """Rows of each table; Parquet footers tell, no column is read."""
        for t in tables:
            if t not in self._counts:
                self._counts[t] = self.spark.table(t).count()
        return self._counts

    def distinct_values(self, table: str, column: str) -> float | None:
        """How many values a column has: its key's rows, its known values, those of the key it points at; else counted once, approximately."""
        t = self.catalog.table(table)
        c = t.column(column) if t else None
        if c is None or t.key == {c.name}:
            return None
        if c.values_complete:
            return float(len(c.values))
        link = next((r for r in t.relationships if r.column.lower() == column.lower()), None)
        if link and (target := self.catalog.table(link.target)) and target.key == {link.target_column}:
            return self.row_counts([target.name])[target.name]
        if (table, column) not in self._values:
            self._values[table, column] = float(self.spark.table(table).agg(F.approx_count_distinct(column)).head()[0])
        return self._values[table, column]

    def plan(self, sql: str, envelope: set[str] | None = None, from_model: bool = False) -> QueryPlan | Refusal:
        """The admitted plan, or the first gate's refusal."""
        began, stage = time.monotonic(), "sql_parse"
        changes: list[str] = []
        try:
            v = grain.Validator(self.catalog)
            checked = policy.check(self.spark, self.catalog, sql, v)
            self.trace.add("sql_parse", "PASS", began)
            self.trace.add("global_policy", "PASS", began)
            stage, began = "execution_authority", time.monotonic()
            policy.authority_gate(checked.tables, envelope, from_model)
            self.trace.add(stage, "PASS", began)
            stage, began = "grain_safety", time.monotonic()
            if v.verdict().code not in (grain.PASS, grain.NOT_APPLICABLE):
                new, why = grain.normalize(self.spark, self.catalog, checked.sql)
                if new is None:
                    raise policy.Rejection(v.verdict().code, f"{v.verdict().measure} would count once for each child row ({why})")
                v = grain.Validator(self.catalog)
                checked = policy.check(self.spark, self.catalog, new, v)
                policy.authority_gate(checked.tables, envelope, from_model)
                changes.append("PRE_AGGREGATED")
            self.trace.add(stage, "PASS", began)
            stage, began = "value_check", time.monotonic()
            values = rewrite.check_values(self.spark, self.catalog, checked.sql)
            changes += [f"VALUE {c}: {a} -> {b}" for c, a, b in values.changes]
            self.trace.add(stage, "PASS", began)
            stage, began = "null_ordering", time.monotonic()
            text, added = rewrite.nulls_last(self.spark, values.sql)
            changes += ["NULLS_LAST"] * added
            self.trace.add(stage, "PASS", began)
            if text != checked.sql:  # every rewrite passes the gates again
                checked = policy.check(self.spark, self.catalog, text)
                policy.authority_gate(checked.tables, envelope, from_model)
            stage, began = "cost_gate", time.monotonic()
            e = cost.estimate(checked.df._jdf.queryExecution().analyzed(), self.row_counts(checked.tables), self.distinct_values)
            cost.cost_gate(e, self.max_plan_rows, self.max_plan_cost)
            self.trace.add(stage, "PASS", began)
            plan = QueryPlan(uuid.uuid4().hex, checked.sql, checked.df, checked.tables, checked.columns, checked.functions, changes, values.unmatched, e)
            return self.tickets.issue(plan)
        except ParseFailure as e:
            self.trace.add("sql_parse", "REJECTED", began, "SQL_PARSE_ERROR")
            return Refusal("sql_parse", "SQL_PARSE_ERROR", str(e))
        except policy.Rejection as e:
            stage = "global_policy" if stage == "sql_parse" else stage
            self.trace.add(stage, "REJECTED", began, e.code)
            return Refusal(stage, e.code, str(e))

    def execute(self, plan: QueryPlan) -> Result:
        """The plan's rows, bounded in number and time; only for the very plan that was issued here."""
        self.tickets.check(plan)
        began = time.monotonic()
        try:
            out = run_bounded(self.spark, plan.df, self.max_rows, self.timeout_s)
            self.trace.add("execution", "PASS", began)
            return out
        except ExecutionError as e:
            self.trace.add("execution", "ERROR", began, e.kind)
            raise

    def probe_values(self, unmatched: list[tuple[str, str]]) -> dict[tuple[str, str], list[str]]:
        """For each (table.column, value) that may not be stored: at most two stored spellings of it."""
        out = {}
        for at, value in unmatched:
            table, column = at.split(".")
            c = self.catalog.table(table).column(column)
            if c is None or not c.queryable or c.sensitivity == "confidential":
                continue
            out[at, value] = [r[0] for r in spellings(self.spark.table(table), column, value).collect()]
        return out


def spellings(df: DataFrame, column: str, value: str, most: int = 2) -> DataFrame:
    """At most ``most`` stored values with the key of a value; built-in functions only, so it runs in the scan's stage."""
    c = F.col(column)
    key = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    key = F.when(key.rlike(r"^\p{Nd}+$"), F.coalesce(F.nullif(F.ltrim(key, F.lit("0")), F.lit("")), F.lit("0"))).otherwise(key)
    return df.where(key == F.lit(rewrite.value_key(value))).select(c.alias("value")).distinct().orderBy("value").limit(most)
