"""Answering a question with a scripted or external proposer: budget, probes, repair, readings, checks."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any, Protocol

from quernel.operators.results import looks_empty, same_rows
from quernel.plans.sharing import rows_shareable
from quernel.plans.execute import ExecutionError, Result
from quernel.plans.parse import parse
from quernel.plans.rewrite import check_values, compared_literals, ties_possible
from quernel.plans.service import GovernedSql, QueryPlan, Refusal
from quernel.plans.context import Context, render, select

KINDS = ("ANSWER", "BLOCKED_AUTHORITY", "NEEDS_CLARIFICATION", "BLOCKED_POLICY", "EXPLORE")
REPAIRABLE = {"SQL_PARSE_ERROR", "UNKNOWN_COLUMN", "UNKNOWN_TABLE", "FORBIDDEN_FUNCTION", "UNAUTHORIZED_JOIN", "PARENT_MEASURE_FANOUT", "DISTINCT_VALUE_FANOUT_MASK", "ANALYSIS_ERROR", "QUERY_TOO_EXPENSIVE"}


@dataclass(frozen=True)
class Decision:
    kind: str
    sql: str | None = None
    relations: tuple[str, ...] = ()
    probes: tuple[str, ...] = ()
    #: Of an answer: other readings to compare it to. Of a clarification: a query for each reading, the likeliest first.
    readings: tuple[str, ...] = ()
    question: str | None = None
    #: What the proposer spent on this decision.
    tokens: int = 0

    def problem(self) -> str | None:
        """What breaks the contract of a decision; None if nothing does."""
        if self.kind not in KINDS:
            return "UNKNOWN_KIND"
        if self.kind == "ANSWER" and (not self.sql or not self.relations):
            return "ANSWER_WITHOUT_SQL_OR_RELATIONS"
        if self.kind == "EXPLORE" and not 1 <= len(self.probes) <= 3:
            return "PROBES_OUT_OF_RANGE"
        if self.kind == "NEEDS_CLARIFICATION" and not self.question:
            return "NO_QUESTION"
        return None


class Proposer(Protocol):
    def propose(self, question: str, context: str, feedback: list[str]) -> Decision: ...


@dataclass
class Scripted:
    """Gives prepared decisions one after the other."""

    decisions: list[Decision]
    seen: list[list[str]] = field(default_factory=list)

    def propose(self, question: str, context: str, feedback: list[str]) -> Decision:
        self.seen.append(list(feedback))
        return self.decisions[min(len(self.seen), len(self.decisions)) - 1]


@dataclass
class Budget:
    """What one run may spend."""

    seconds: float = 120.0
    calls: int = 6
    explore_rounds: int = 2
    repairs: int = 1
    expansions: int = 1
    looks: int = 1
    tokens: int = 150_000
    #: Probes and readings that may run; None: as many as the rounds allow.
    queries: int | None = None
    clock: Callable[[], float] = time.monotonic
    started: float | None = None

    def take(self, what: str) -> bool:
        self.started = self.clock() if self.started is None else self.started
        left = getattr(self, what)
        if left is None:
            left = 1_000_000
        if left <= 0 or self.tokens <= 0 or self.clock() - self.started > self.seconds:
            return False
        setattr(self, what, left - 1)
        return True

    def spend(self, tokens: int) -> None:
        """Tokens of a call that was made; when none are left, nothing more is taken."""
        self.tokens -= tokens

    def limit(self) -> str:
        """What ended the run."""
        if self.tokens <= 0:
            return "TOKENS"
        return "DEADLINE" if self.started is not None and self.clock() - self.started > self.seconds else "CALLS"

    @classmethod
    def for_replay(cls) -> Budget:
        return cls(calls=0, explore_rounds=0, repairs=0, expansions=0, looks=0)


@dataclass
class Answer:
    outcome: str
    reason: str | None = None
    result: Result | None = None
    plan: QueryPlan | None = None
    notes: list[str] = field(default_factory=list)
    question: str | None = None
    #: Results of the other readings, where one was assumed.
    alternatives: list[tuple[str, Result]] = field(default_factory=list)
    decision: str | None = None
    proposed: str | None = None
    context_hash: str | None = None


LOOKED_AT = {"NEEDS_CLARIFICATION", "BLOCKED_AUTHORITY"}


def answer(
    service: GovernedSql,
    proposer: Proposer,
    question: str,
    budget: Budget | None = None,
    allowed: set[str] | None = None,
    shared: frozenset[tuple[str, str]] = frozenset(),
    mode: str = "ask",
    log: Callable[[dict[str, Any]], None] | None = None,
    about: dict[str, Any] | None = None,
) -> Answer:
    """Asks the proposer until a query is admitted and run, or the budget ends.

    ``allowed`` are the relations of the request; without it, those of the
    context that the proposer was shown. Nothing it writes, probes included, may
    read others. ``shared`` are columns whose stored values it may see in probes.
    ``mode`` says what happens when a clarification's readings differ: ask, or
    assume the first. ``log`` gets one record of the run (never its rows), with
    the fields of ``about``.
    """
    began = time.monotonic()
    out = _answer(service, proposer, question, budget or Budget(), allowed, shared, mode)
    if log is not None:
        log(record(service, question, out, (time.monotonic() - began) * 1000) | (about or {}))
    return out


def record(service: GovernedSql, question: str, out: Answer, duration_ms: float) -> dict[str, Any]:
    """The audit record of a run."""
    stages = list(service.trace.stages)
    return {
        "run_id": f"run_{uuid.uuid4().hex}", "question": question, "proposal_source": "LIVE_MODEL" if out.decision else "REPLAY",
        "model_decision": out.decision, "model_context_hash": out.context_hash, "runtime_outcome": out.outcome, "runtime_reason": out.reason,
        "proposed_sql": out.proposed, "executed_sql": out.plan.sql if out.plan else None, "sql_changes": out.plan.changes if out.plan else [],
        "columns": out.result.columns if out.result else [], "row_count": out.result.row_count if out.result else None, "truncated": bool(out.result and out.result.truncated),
        "duration_ms": round(duration_ms, 3), "trace": {"status": out.outcome, "stages": stages},
    }


def _answer(service: GovernedSql, proposer: Proposer, question: str, budget: Budget, allowed: set[str] | None, shared: frozenset[tuple[str, str]], mode: str) -> Answer:
    def read(extra: set[str] = frozenset()) -> tuple[Context, dict, set[str]]:
        context = select(service.catalog, question, extra)
        return context, render(context, service.catalog), {t.name for t in context.tables} if allowed is None else allowed

    context, shown, authority = read()
    feedback: list[str] = []
    looked = False
    while budget.take("calls"):
        d = proposer.propose(question, shown["text"], feedback)
        budget.spend(d.tokens)

        def told(out: Answer, d: Decision = d) -> Answer:
            out.decision, out.proposed, out.context_hash = d.kind, d.sql, shown["sha256"]
            return out

        wrong = d.problem()
        if wrong:
            if not budget.take("repairs"):
                return told(Answer("INVALID_PROPOSAL", wrong))
            feedback.append(wrong)
            continue
        wanted = set(d.relations) & set(context.omitted)
        if wanted and budget.take("expansions"):  # tables that were left out of what the proposer saw
            context, shown, authority = read(wanted)
            feedback.append(f"CONTEXT_EXPANDED: {', '.join(sorted(wanted))}")
            continue
        if d.kind == "NEEDS_CLARIFICATION" and len(d.readings) > 1:
            checked = _readings(service, d, authority, budget, mode)
            if checked is not None:
                return told(checked)
        if d.kind in LOOKED_AT and not looked and budget.explore_rounds > 0 and budget.take("looks"):
            looked = True  # the data may settle it: back once, to look first
            feedback.append(f"LOOK_FIRST: {d.kind} came before any look at the data")
            continue
        if d.kind in ("BLOCKED_AUTHORITY", "BLOCKED_POLICY"):
            return told(Answer(d.kind))
        if d.kind == "NEEDS_CLARIFICATION":
            return told(Answer(d.kind, question=d.question))
        if d.kind == "EXPLORE":
            looked = True
            if not budget.take("explore_rounds"):
                feedback.append("NO_EXPLORATION_LEFT")
                continue
            feedback += [_probe(service, p, authority, shared) if budget.take("queries") else "PROBE BUDGET_PROBE_QUERIES" for p in d.probes]
            continue
        out = told(run_sql(service, d.sql, set(d.relations) & authority, d.readings))
        if out.outcome == "EXECUTED" or out.reason not in REPAIRABLE or not budget.take("repairs"):
            return out
        feedback.append(f"{out.reason}: {'; '.join(out.notes)}")
    return Answer("BUDGET_EXHAUSTED", f"BUDGET_{budget.limit()}")


def _readings(service: GovernedSql, d: Decision, authority: set[str], budget: Budget, mode: str) -> Answer | None:
    """What a clarification comes to when each of its readings is run: an answer if all agree or one is assumed; None if it stands."""
    ran: list[tuple[str, QueryPlan, Result]] = []
    for sql in d.readings:
        plan = service.plan(sql, authority, from_model=True) if budget.take("queries") else None
        if not isinstance(plan, QueryPlan):
            return None
        try:
            ran.append((sql, plan, service.execute(plan)))
        except ExecutionError:
            return None
    _, plan, first = ran[0]
    rows = lambda r: [tuple(x.values()) for x in r.rows]
    agree = not any(r.truncated for _, _, r in ran) and all(len(r.columns) == len(first.columns) and same_rows(rows(first), rows(r)) for _, _, r in ran)
    if agree:
        return Answer("EXECUTED", None, first, plan, [*plan.changes, "READINGS_AGREE"])
    if mode != "assume":
        return None
    return Answer("EXECUTED", None, first, plan, [*plan.changes, "READING_ASSUMED"], d.question, [(sql, r) for sql, _, r in ran[1:]])


def replay(service: GovernedSql, sql: str, relations: set[str]) -> Answer:
    """A saved or edited query: the same gates, no proposer and no repair."""
    return run_sql(service, sql, relations, ())


def run_sql(service: GovernedSql, sql: str, envelope: set[str], readings: tuple[str, ...] = ()) -> Answer:
    plan = service.plan(sql, envelope, from_model=True)
    if isinstance(plan, Refusal):
        return Answer("REJECTED", plan.code, notes=[plan.message])
    try:
        result = service.execute(plan)
    except ExecutionError as e:
        return Answer("EXECUTION_ERROR", e.kind, plan=plan, notes=[str(e)])
    notes = list(plan.changes)
    if looks_empty(result.rows):
        respelled = _respell(service, plan)
        if respelled:
            again = run_sql(service, respelled, envelope)
            again.notes.insert(0, "RESPELLED")
            return again
        notes.append("EMPTY_RESULT")
    if len(result.rows) > 1 and ties_possible(plan.df):
        notes.append("TIES")
    for other in readings:
        second = service.plan(other, envelope, from_model=True)
        if isinstance(second, QueryPlan):
            r = service.execute(second)
            if r.truncated or result.truncated:
                notes.append("READING_UNCHECKED")
            elif not same_rows([tuple(x.values()) for x in result.rows], [tuple(x.values()) for x in r.rows]):
                return Answer("NEEDS_CLARIFICATION", "READINGS_DIFFER", result, plan, notes)
    return Answer("EXECUTED", None, result, plan, notes)


def _respell(service: GovernedSql, plan: QueryPlan) -> str | None:
    """The query with a literal in its stored spelling, where exactly one is stored under its key."""
    from quernel.plans.parse import splice

    edits = []
    for lit in compared_literals(parse(service.spark, plan.sql), service.catalog):
        found = service.probe_values([(f"{lit.table}.{lit.column}", lit.value)]).get((f"{lit.table}.{lit.column}", lit.value), [])
        if len(found) == 1 and found[0] != lit.value:
            edits.append((lit.start, lit.stop, "'" + found[0].replace("'", "\\'") + "'"))
    return splice(plan.sql, edits) if edits else None


PROBE_ROWS, PROBE_TEXT = 20, 80


def _probe(service: GovernedSql, sql: str, authority: set[str], shared: frozenset[tuple[str, str]], respelled: bool = False) -> str:
    """What a probe shows: rows, each column's distinct values and nulls, and the first rows if every column read is shared.

    An empty probe runs again with a literal in its stored spelling, where that
    is the only one.
    """
    plan = service.plan(sql, authority, from_model=True)
    if isinstance(plan, Refusal):
        return f"PROBE {plan.code}"
    try:
        r = service.execute(plan)
    except ExecutionError as e:
        return f"PROBE {e.kind}"
    if looks_empty(r.rows) and not respelled and (new := _respell(service, plan)):
        return _probe(service, new, authority, shared, True) + "; RESPELLED"
    columns = []
    for c in r.columns:
        values = [row[c] for row in r.rows]
        known = {probe_text(v) for v in values if v is not None}
        columns.append(f"{c} {len(known)} distinct {sum(v is None for v in values)} null")
    said = f"PROBE {r.row_count}{'+' * r.truncated} rows; {', '.join(columns)}"
    if rows_shareable(plan.columns, service.catalog, shared):
        said += "".join("\n" + " | ".join("NULL" if v is None else probe_text(v) for v in row.values()) for row in r.rows[:PROBE_ROWS])
    return said


def probe_text(v: Any) -> str:
    """A value as a proposer sees it: dates in ISO form, decimals without exponent, long texts cut."""
    text = v.isoformat() if hasattr(v, "isoformat") else format(v, "f") if isinstance(v, Decimal) else str(v)
    return text if len(text) <= PROBE_TEXT else text[: PROBE_TEXT - 1] + "…"


def thread(runs: dict[str, dict[str, Any]], run_id: str, most: int = 10) -> list[str]:
    """The run's conversation, earliest first, by its pointers; ends at a loop."""
    out: list[str] = []
    x: str | None = run_id
    while x in runs and x not in out and len(out) < most:
        out.append(x)
        x = runs[x].get("follow_up_of") or runs[x].get("edited_from")
    return out[::-1]


__all__ = ["Answer", "Budget", "Decision", "Proposer", "Scripted", "answer", "check_values", "replay", "thread"]
