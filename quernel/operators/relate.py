"""Links between tables: candidates by name and type, checks of declarations, merging declared links."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.catalog import Catalog, Relationship, Table, compatible
from quernel.operators.profile import has_duplicates, match_rate

MOST_CANDIDATES, LEAST_RATE = 40, 0.5


@dataclass(frozen=True)
class Candidate:
    table: str
    column: str
    target: str
    target_column: str
    rate: float | None = None


def _stem(name: str) -> str:
    """The part of a column name that says what it points at: without a table prefix and key endings."""
    low = name.lower()
    head, _, rest = low.partition("_")
    bare = rest if rest and len(head) <= 2 else low
    for tail in ("_id", "_key", "_code", "key", "id"):
        if bare.endswith(tail) and len(bare) > len(tail):
            return bare[: -len(tail)].rstrip("_")
    return bare


def candidates(catalog: Catalog, unique: dict[str, set[str]], most: int = MOST_CANDIDATES) -> list[Candidate]:
    """Undeclared links that names and types suggest, to columns known to be unique."""
    declared = {(t.name, r.column) for t in catalog.tables for r in t.relationships}
    out = []
    for t in catalog.tables:
        for c in t.columns:
            if (t.name, c.name) in declared:
                continue
            for target in catalog.tables:
                for name in sorted(unique.get(target.name, ())):
                    k = target.column(name)
                    if target.name == t.name or k is None or not compatible(c.type, k.type):
                        continue
                    if _stem(c.name) == _stem(name) or _stem(c.name) in (target.name, target.name.rstrip("s")):
                        out.append(Candidate(t.name, c.name, target.name, name))
    return out[:most]


def verified(spark: SparkSession, some: list[Candidate], least: float = LEAST_RATE) -> list[Candidate]:
    """Candidates whose values the target mostly stores, with the share: one job over all, on pruned columns."""
    if not some:
        return []
    each = [
        match_rate(spark.table(c.table).select(c.column), c.column, spark.table(c.target).select(c.target_column), c.target_column).select(F.lit(i).alias("i"), "rate")
        for i, c in enumerate(some)
    ]
    rates = {r["i"]: r["rate"] for r in reduce(DataFrame.unionByName, each).collect()}  # MOST_CANDIDATES rows at most
    return [replace(c, rate=rates[i]) for i, c in enumerate(some) if rates[i] is not None and rates[i] >= least]


def check_declaration(spark: SparkSession, catalog: Catalog, table: str, r: Relationship) -> str | None:
    """Why a link can't be declared; None if it can."""
    t, target = catalog.table(table), catalog.table(r.target)
    if t is None or target is None or t.column(r.column) is None or target.column(r.target_column) is None:
        return "NOT_FOUND"
    if t.name == target.name and r.column == r.target_column:
        return "SELF"
    if not compatible(t.column(r.column).type, target.column(r.target_column).type):
        return "INCOMPATIBLE_TYPES"
    if any(x.column == r.column and x.target == r.target for x in t.relationships):
        return "DUPLICATE"
    if any(x.column == r.column for x in t.relationships) or _meets(catalog, t.name, target.name):
        return "OTHER_PATH"
    if target.key != {r.target_column} and has_duplicates(spark.table(target.name).select(r.target_column), r.target_column):
        return "TARGET_NOT_UNIQUE"
    return None


def _meets(catalog: Catalog, a: str, b: str) -> bool:
    """Whether two tables are linked already, by columns of their own that point at each other or at one key."""
    return any({t for t, _ in edge} == {a, b} for edge in catalog.edges)


def merge_declared(catalog: Catalog, declared: dict[str, list[Relationship]]) -> tuple[Catalog, list[tuple[str, Relationship]]]:
    """The catalog with declared links, and those dropped because a table or column is gone."""
    stale: list[tuple[str, Relationship]] = []
    tables: list[Table] = []
    for t in catalog.tables:
        fresh = []
        for r in declared.get(t.name, []):
            target = catalog.table(r.target)
            ok = t.column(r.column) and target and target.column(r.target_column)
            (fresh if ok else stale).append(r if ok else (t.name, r))
        tables.append(replace(t, relationships=tuple(dict.fromkeys([*t.relationships, *fresh]))))
    stale += [(n, r) for n, rs in declared.items() if catalog.table(n) is None for r in rs]
    return Catalog(tuple(tables)), stale
