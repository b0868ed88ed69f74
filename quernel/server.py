"""A small HTTP surface over the governed queries, the audit log, reports and sources; stages of a run as they end.

Nothing here decides anything: every query passes the gates of the service,
and the actor, named by whoever stands in front (``X-Actor``), has the roles
that reports give them. Errors come as ``{"code", "message"}``.
"""

from __future__ import annotations

import json
import queue
import re
import threading
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import functions as F

from quernel.catalog import Catalog
from quernel.functions.surface import listing
from quernel.operators.report import filter_options
from quernel.plans.decide import Answer, Proposer, answer, record, replay
from quernel.plans.reports import Report, ReportError, Reports
from quernel.plans.rewrite import explain
from quernel.plans.service import GovernedSql, Trace
from quernel.sources.audit import append_run, read_runs
from quernel.sources.connectors import CONNECTORS, validate_options

MOST_RUNS = 200
STATUS = {"NOT_FOUND": 404, "FORBIDDEN": 403, "CONFLICT": 409, "REJECTED": 422}


class Problem(Exception):
    def __init__(self, status: int, code: str, message: str) -> None:
        super().__init__(message)
        self.status, self.code = status, code


def shown(out: Answer) -> dict[str, Any]:
    """An answer as it is sent: rows only of an executed query."""
    r = out.result
    return {
        "outcome": out.outcome, "reason": out.reason, "notes": out.notes, "question": out.question,
        "sql": out.plan.sql if out.plan else None, "columns": r.columns if r else [], "rows": r.rows if r else [], "row_count": r.row_count if r else 0, "truncated": bool(r and r.truncated),
    }


def visible(catalog: Catalog) -> list[dict[str, Any]]:
    """What may be asked about: tables, their readable columns, links."""
    return [
        {"name": t.name, "description": t.description, "columns": [{"name": c.name, "type": c.type, "key": c.primary_key} for c in t.columns if c.queryable], "links": [f"{r.column} -> {r.target}.{r.target_column}" for r in t.relationships]}
        for t in catalog.tables
        if t.queryable
    ]


class Surface:
    """What each request does; the routes call its methods."""

    def __init__(self, make: Callable[[], GovernedSql], log_path: str, reports_root: str, proposer: Proposer | None = None, clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc).replace(tzinfo=None)) -> None:
        self.make, self.log_path, self.proposer, self.clock = make, log_path, proposer, clock
        self.spark = make().spark
        self.reports = Reports(self.spark, reports_root, make())

    # -- questions -----------------------------------------------------------------

    def ask(self, body: dict[str, Any], actor: str, listener: Callable[[dict], None] | None = None) -> dict[str, Any]:
        """Runs a statement under its relations, or puts a question to the proposer; either is logged."""
        service = self.make()
        service.trace = Trace(listener=listener)
        began = self.clock()
        if body.get("sql"):
            out = replay(service, body["sql"], set(body.get("relations", [])))
            out.proposed = body["sql"]
        elif self.proposer is not None and body.get("question"):
            out = answer(service, self.proposer, body["question"], allowed=set(body["relations"]) if "relations" in body else None, mode=body.get("mode", "ask"))
        else:
            raise Problem(422, "REJECTED", "a statement is needed, or a question where a proposer is set")
        row = record(service, body.get("question", ""), out, (self.clock() - began).total_seconds() * 1000) | {"actor": actor, "follow_up_of": body.get("follow_up_of"), "edited_from": body.get("edited_from")}
        append_run(self.spark, self.log_path, row)
        return shown(out) | {"run_id": row["run_id"]}

    def stream(self, body: dict[str, Any], actor: str) -> Iterator[str]:
        """The same, as events: each stage as it ends, then the answer."""
        stages: queue.Queue = queue.Queue()

        def run() -> None:
            try:
                stages.put(("answer", self.ask(body, actor, lambda s: stages.put(("stage", s)))))
            except Exception as e:  # noqa: BLE001  the client is told, the thread ends
                stages.put(("error", {"code": getattr(e, "code", "ERROR"), "message": str(e).split("\n")[0]}))

        threading.Thread(target=run, daemon=True).start()
        while True:
            kind, value = stages.get()
            yield f"event: {kind}\ndata: {json.dumps(value, default=str)}\n\n"
            if kind != "stage":
                return

    def runs(self, actor: str) -> list[dict[str, Any]]:
        """The actor's latest runs."""
        mine = read_runs(self.spark, self.log_path).where(F.lower("actor") == actor.lower())
        return [r.asDict() for r in mine.orderBy("created_at", ascending=False).drop("trace").limit(MOST_RUNS).collect()]

    def run(self, run_id: str) -> dict[str, Any]:
        found = read_runs(self.spark, self.log_path).where(F.col("run_id") == run_id).limit(1).collect()
        if not found:
            raise Problem(404, "NOT_FOUND", f"there is no run {run_id}")
        return found[0].asDict()

    def explained(self, body: dict[str, Any]) -> dict[str, Any]:
        return explain(self.spark, self.make().catalog, body["sql"])

    def values(self, table: str, column: str) -> list[Any]:
        """The options of a filter."""
        catalog = self.make().catalog
        t = catalog.table(table)
        c = t.column(column) if t and t.queryable else None
        if c is None or not c.queryable:
            raise Problem(404, "NOT_FOUND", f"there is no column {table}.{column}")
        return [r[0] for r in filter_options(self.spark.table(t.name).select(c.name), c.name).collect()]

    # -- reports -----------------------------------------------------------------------

    def update(self, report_id: str, body: dict[str, Any], actor: str) -> Report:
        return self.reports.update(report_id, actor, int(body["version"]), self.clock(), **{k: tuple(v) if k == "filters" else v for k, v in body.items() if k in ("title", "description", "cards", "filters")})


#: Method, path, what it calls with the surface, the parts of the path, the body and the actor.
ROUTES: list[tuple[str, str, Callable[..., Any]]] = [
    ("GET", "/health", lambda s, b, a: {"status": "ok"}),
    ("GET", "/functions", lambda s, b, a: listing()),
    ("GET", "/schema", lambda s, b, a: visible(s.make().catalog)),
    ("GET", "/connectors", lambda s, b, a: [{"kind": c.kind, "label": c.label, "queryable": c.queryable, "fields": [vars(f) for f in c.fields]} for c in CONNECTORS.values()]),
    ("POST", "/connections/check", lambda s, b, a: dict(zip(("options", "problems"), validate_options(b["kind"], b.get("options", {})), strict=True))),
    ("POST", "/query", lambda s, b, a: s.ask(b, a)),
    ("POST", "/query/stream", lambda s, b, a: s.stream(b, a)),
    ("POST", "/explain", lambda s, b, a: s.explained(b)),
    ("GET", "/runs", lambda s, b, a: s.runs(a)),
    ("GET", r"/runs/(\w+)", lambda s, b, a, i: s.run(i)),
    ("GET", r"/values/(\w+)/(\w+)", lambda s, b, a, t, c: s.values(t, c)),
    ("GET", "/reports", lambda s, b, a: s.reports.all(a)),
    ("POST", "/reports", lambda s, b, a: s.reports.create(a, b["connection_id"], b.get("title", ""), s.clock())),
    ("GET", r"/reports/(\w+)", lambda s, b, a, i: s.reports.get(i, a)),
    ("PUT", r"/reports/(\w+)", lambda s, b, a, i: s.update(i, b, a)),
    ("DELETE", r"/reports/(\w+)", lambda s, b, a, i: s.reports.delete(i, a, s.clock())),
    ("POST", r"/reports/(\w+)/share", lambda s, b, a, i: s.reports.share(i, a, s.clock(), b["visibility"], tuple(b.get("editors", ())), tuple(b.get("viewers", ())))),
    ("POST", r"/reports/(\w+)/schedule", lambda s, b, a, i: s.reports.schedule(i, a, s.clock(), b.get("every"))),
    ("POST", r"/reports/(\w+)/refresh", lambda s, b, a, i: s.reports.refresh(i, a, s.clock())),
    ("POST", r"/reports/(\w+)/accept/([\w-]+)", lambda s, b, a, i, c: s.reports.accept(i, a, s.clock(), c)),
]


def handle(surface: Surface, method: str, path: str, body: dict[str, Any], actor: str) -> tuple[int, Any]:
    """Status and value of a request; the value is an iterator of events where stages are streamed."""
    for m, pattern, call in ROUTES:
        found = re.fullmatch(pattern, path)
        if m == method and found:
            try:
                out = call(surface, body, actor, *found.groups())
                return (204, None) if out is None else (200, vars(out) if isinstance(out, Report) else [vars(r) if isinstance(r, Report) else r for r in out] if isinstance(out, list) else out)
            except Problem as e:
                return e.status, {"code": e.code, "message": str(e)}
            except ReportError as e:
                return STATUS.get(e.code, 400), {"code": e.code, "message": str(e)}
            except (KeyError, TypeError, ValueError) as e:
                return 422, {"code": "REJECTED", "message": str(e).split("\n")[0]}
    return 404, {"code": "NOT_FOUND", "message": f"{method} {path}"}


def serve(surface: Surface, port: int = 8080, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server of the surface, not yet running: call ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            try:
                body = json.loads(self.rfile.read(size) or b"{}")
            except ValueError:
                body = None
            actor = (self.headers.get("X-Actor") or "").strip()
            status, out = (422, {"code": "REJECTED", "message": "the body is no JSON object"}) if not isinstance(body, dict) else handle(surface, self.command, self.path.split("?")[0], body, actor)
            self.send_response(status)
            if isinstance(out, Iterator):
                self.send_header("Content-Type", "text/event-stream")
                self.end_headers()
                for event in out:
                    self.wfile.write(event.encode())
                    self.wfile.flush()
                return
            data = b"" if out is None else json.dumps(out, default=str).encode()
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PUT = do_DELETE = _do

        def log_message(self, *args: Any) -> None:
            """Requests are told by the audit log."""

    return ThreadingHTTPServer((host, port), Handler)
