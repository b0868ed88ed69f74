"""Saved cards: what their query relies on, and running them again under filters."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quernel.catalog import changed_tables, fingerprint
from quernel.operators.report import MOST_SNAPSHOT_ROWS
from quernel.plans.decide import Answer, replay
from quernel.plans.rewrite import filter_table
from quernel.plans.service import GovernedSql, QueryPlan


@dataclass(frozen=True)
class Filter:
    table: str
    column: str
    values: tuple[str, ...] | None = None
    day: str | None = None


@dataclass(frozen=True)
class Card:
    sql: str
    basis: dict[str, str]


def pin(service: GovernedSql, sql: str) -> Card:
    """A card of an admitted query, with the fingerprints of the tables it reads."""
    plan = service.plan(sql)
    if not isinstance(plan, QueryPlan):
        raise ValueError(f"{plan.code}: {plan.message}")
    return Card(plan.sql, {t: fingerprint(service.catalog.table(t)) for t in plan.tables})


@dataclass
class Refreshed:
    answer: Answer
    changed: list[str] = field(default_factory=list)
    unfiltered: list[str] = field(default_factory=list)
    rows: list[dict[str, Any]] = field(default_factory=list)
    cut: bool = False


def refresh(service: GovernedSql, card: Card, filters: tuple[Filter, ...] = ()) -> Refreshed:
    """The card's rows (as many as a snapshot keeps), tables that changed since it was pinned, filters that didn't apply everywhere."""
    sql, unfiltered = card.sql, []
    for f in filters:
        sql, n, skipped = filter_table(service.spark, service.catalog, sql, f.table, f.column, list(f.values) if f.values is not None else None, f.day)
        if skipped or not n:
            unfiltered.append(f"{f.table}.{f.column}")
    out = replay(service, sql, set(card.basis))
    rows = out.result.rows if out.result else []
    return Refreshed(out, changed_tables(card.basis, service.catalog), unfiltered, rows[:MOST_SNAPSHOT_ROWS], len(rows) > MOST_SNAPSHOT_ROWS or bool(out.result and out.result.truncated))


def rows_of(spark: SparkSession, out: Answer) -> DataFrame:
    """The admitted query of an answer, whole."""
    if out.plan is None:
        raise ValueError(f"{out.outcome}: {out.reason}")
    return out.plan.df


@dataclass
class StatisticsCache:
    """Column statistics kept for a while; where they can't be computed the last ones, or none, are given."""

    compute: Callable[[str], Any]
    seconds: float = 600.0
    clock: Callable[[], float] = time.monotonic
    held: dict[str, tuple[float, Any]] = field(default_factory=dict)

    def get(self, key: str) -> Any | None:
        old = self.held.get(key)
        if old and self.clock() - old[0] < self.seconds:
            return old[1]
        try:
            value = self.compute(key)
        except Exception:  # noqa: BLE001  statistics never stop a question
            return old[1] if old else None
        self.held[key] = (self.clock(), value)
        return value
