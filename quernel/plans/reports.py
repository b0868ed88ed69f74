"""Saved reports: who may do what, versions, schedules, snapshots of their cards.

A report is a folder of versions, one JSON file each, in any file system that
Spark reads. A version is made by creating its file, which only one writer can
do, so a save that was opened on an older version fails (optimistic locking), and
of several schedulers that claim a due report one wins. All reports, and all
snapshots, are tables: ``table`` and ``snapshot_table`` read them with Spark.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernel.operators.report import MOST_SNAPSHOTS, latest_snapshots
from quernel.plans.refresh import Card, Filter, pin, refresh
from quernel.plans.service import GovernedSql

OWNER, EDITOR, VIEWER = "owner", "editor", "viewer"
MOST_CARDS = 60
#: How often a scheduled report runs.
EVERY = {"hourly": timedelta(hours=1), "daily": timedelta(days=1), "weekly": timedelta(weeks=1)}
STORED = "id string, version int, connection_id string, title string, description string, cards string, filters string, visibility string, editors array<string>, viewers array<string>, schedule string, next_refresh_at string, created_by string, created_at string, updated_by string, updated_at string, deleted boolean"
SNAPSHOT = "id string, report_id string, taken_at string, taken_by string, scheduled boolean, cards string"


class ReportError(Exception):
    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Report:
    id: str
    connection_id: str
    title: str
    created_by: str
    created_at: str
    description: str = ""
    #: Card id to {sql, basis, title, chart}.
    cards: dict[str, dict[str, Any]] = field(default_factory=dict)
    filters: tuple[dict[str, Any], ...] = ()
    visibility: str = "private"
    editors: tuple[str, ...] = ()
    viewers: tuple[str, ...] = ()
    schedule: str | None = None
    next_refresh_at: str | None = None
    updated_by: str = ""
    updated_at: str = ""
    version: int = 1
    deleted: bool = False

    def role(self, actor: str) -> str | None:
        """The actor's role, letter case aside; None if they may not open it."""
        who = actor.strip().casefold()
        named = lambda some: who in {x.strip().casefold() for x in some}
        if who == self.created_by.strip().casefold():
            return OWNER
        if named(self.editors):
            return EDITOR
        return VIEWER if named(self.viewers) or self.visibility == "everyone" else None


class Files:
    """Text files in the file system of a folder, each created once."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root, self.jvm = root.rstrip("/"), spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def create(self, name: str, text: str) -> bool:
        """Whether the file was made; False if it was there."""
        if self.fs.exists(self._path(name)):
            return False
        try:
            out = self.fs.create(self._path(name), False)
        except Exception as e:  # noqa: BLE001  another writer was first
            if "AlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


class Reports:
    """Reports and snapshots below one folder."""

    def __init__(self, spark: SparkSession, root: str, service: GovernedSql) -> None:
        self.spark, self.service, self.files, self.root = spark, service, Files(spark, root), root.rstrip("/")

    # -- reading and saving ------------------------------------------------------

    def _latest(self, report_id: str) -> Report | None:
        versions = [n for n in self.files.names(f"reports/{report_id}") if n.endswith(".json")]
        if not versions:
            return None
        stored = json.loads(self.files.read(f"reports/{report_id}/{versions[-1]}"))
        stored |= {k: json.loads(stored[k]) for k in ("cards", "filters")}
        found = Report(**{k: tuple(v) if isinstance(v, list) else v for k, v in stored.items()})
        return None if found.deleted else found

    def _save(self, report: Report) -> Report:
        stored = asdict(report) | {"cards": json.dumps(report.cards), "filters": json.dumps(report.filters)}
        if not self.files.create(f"reports/{report.id}/{report.version:08d}.json", json.dumps(stored)):
            raise ReportError("CONFLICT", f"{report.id} was saved by somebody else meanwhile")
        return report

    def _changed(self, report: Report, actor: str, now: datetime, **new: Any) -> Report:
        return self._save(replace(report, **new, updated_by=actor, updated_at=now.isoformat(), version=report.version + 1))

    def get(self, report_id: str, actor: str, need: tuple[str, ...] = (OWNER, EDITOR, VIEWER)) -> Report:
        """The report; one that the actor may not open reads as missing."""
        found = self._latest(report_id)
        role = found.role(actor) if found else None
        if found is None or role is None:
            raise ReportError("NOT_FOUND", f"there is no report {report_id}")
        if role not in need:
            raise ReportError("FORBIDDEN", f"a {role} can't do this")
        return found

    def create(self, actor: str, connection_id: str, title: str, now: datetime) -> Report:
        if not title.strip():
            raise ReportError("REJECTED", "a report needs a title")
        at = now.isoformat()
        return self._save(Report(f"rep_{uuid.uuid4().hex[:12]}", connection_id, title.strip(), actor, at, updated_by=actor, updated_at=at))

    def update(self, report_id: str, actor: str, version: int, now: datetime, title: str | None = None, description: str | None = None, cards: dict[str, dict[str, Any]] | None = None, filters: tuple[dict[str, Any], ...] | None = None) -> Report:
        """A new version, of the one that the actor had opened; new or changed statements pass the gates and pin their basis."""
        old = self.get(report_id, actor, (OWNER, EDITOR))
        if version != old.version:
            raise ReportError("CONFLICT", f"version {old.version} was saved after version {version} was opened")
        new: dict[str, Any] = {}
        if title is not None:
            if not title.strip():
                raise ReportError("REJECTED", "a report needs a title")
            new["title"] = title.strip()
        if description is not None:
            new["description"] = description
        if cards is not None:
            if len(cards) > MOST_CARDS:
                raise ReportError("REJECTED", f"a report holds at most {MOST_CARDS} cards")
            new["cards"] = {i: self._pinned(c, old.cards.get(i)) for i, c in cards.items()}
        if filters is not None:
            for f in filters:
                t = self.service.catalog.table(f["table"])
                if t is None or t.column(f["column"]) is None:
                    raise ReportError("REJECTED", f"there is no column {f['table']}.{f['column']} to filter by")
            new["filters"] = tuple(filters)
        return self._changed(old, actor, now, **new)

    def _pinned(self, card: dict[str, Any], before: dict[str, Any] | None) -> dict[str, Any]:
        if "sql" not in card or before and before.get("sql") == card["sql"]:
            return card | ({"basis": before["basis"]} if before and "basis" in before else {})
        try:
            made = pin(self.service, card["sql"])
        except ValueError as e:
            raise ReportError("REJECTED", str(e)) from e
        return card | {"sql": made.sql, "basis": made.basis}

    def share(self, report_id: str, actor: str, now: datetime, visibility: str, editors: tuple[str, ...] = (), viewers: tuple[str, ...] = ()) -> Report:
        if visibility not in ("private", "everyone"):
            raise ReportError("REJECTED", f"{visibility} is no visibility")
        return self._changed(self.get(report_id, actor, (OWNER,)), actor, now, visibility=visibility, editors=tuple(editors), viewers=tuple(viewers))

    def delete(self, report_id: str, actor: str, now: datetime) -> None:
        """A last version that says so; the versions and snapshots before stay in the log."""
        self._changed(self.get(report_id, actor, (OWNER,)), actor, now, deleted=True)

    def all(self, actor: str) -> list[Report]:
        found = (self._latest(n) for n in self.files.names("reports"))
        return [r for r in found if r is not None and r.role(actor) is not None]

    # -- schedules and snapshots -------------------------------------------------

    def schedule(self, report_id: str, actor: str, now: datetime, every: str | None) -> Report:
        if every is not None and every not in EVERY:
            raise ReportError("REJECTED", f"{every} is no schedule")
        following = (now + EVERY[every]).isoformat() if every else None
        return self._changed(self.get(report_id, actor, (OWNER, EDITOR)), actor, now, schedule=every, next_refresh_at=following)

    def claim(self, report: Report, now: datetime) -> bool:
        """Whether this caller, and no other, runs the report for the time at which it was due."""
        if not report.next_refresh_at or report.next_refresh_at > now.isoformat():
            return False
        if not self.files.create(f"claims/{report.id}/{report.next_refresh_at.replace(':', '')}", now.isoformat()):
            return False
        following = datetime.fromisoformat(report.next_refresh_at)
        while following <= now:
            following += EVERY[report.schedule]
        self._save(replace(report, next_refresh_at=following.isoformat(), version=report.version + 1))
        return True

    def run_due(self, now: datetime) -> list[str]:
        """Snapshots of all reports that are due and that nobody else has claimed; their ids."""
        some = (self._latest(n) for n in self.files.names("reports"))
        return [self.snapshot(r, r.created_by, now, True)["id"] for r in some if r is not None and self.claim(r, now)]

    def refresh(self, report_id: str, actor: str, now: datetime) -> dict[str, Any]:
        return self.snapshot(self.get(report_id, actor), actor, now, False)

    def snapshot(self, report: Report, actor: str, now: datetime, scheduled: bool) -> dict[str, Any]:
        """Runs all cards under the report's filters and keeps their rows, as many as a snapshot holds; the oldest snapshots go."""
        filters = tuple(Filter(f["table"], f["column"], tuple(f["values"]) if f.get("values") is not None else None, f.get("day")) for f in report.filters)
        cards = {}
        for i, c in report.cards.items():
            if "sql" not in c:
                continue
            r = refresh(self.service, Card(c["sql"], c["basis"]), filters)
            cards[i] = {"outcome": r.answer.outcome, "reason": r.answer.reason, "changed": r.changed, "unfiltered": r.unfiltered, "columns": r.answer.result.columns if r.answer.result else [], "rows": r.rows, "truncated": r.cut}
        made = {"id": f"snap_{uuid.uuid4().hex[:12]}", "report_id": report.id, "taken_at": now.isoformat(), "taken_by": actor, "scheduled": scheduled, "cards": json.dumps(cards, default=str)}
        self.files.create(f"snapshots/{report.id}/{now.isoformat().replace(':', '')}-{made['id']}.json", json.dumps(made))
        for old in self.files.names(f"snapshots/{report.id}")[:-MOST_SNAPSHOTS]:
            self.files.delete(f"snapshots/{report.id}/{old}")
        return made

    def accept(self, report_id: str, actor: str, now: datetime, card_id: str) -> Report:
        """Takes the tables as they are now for a card whose basis has changed; its statement passes the gates again."""
        old = self.get(report_id, actor, (OWNER, EDITOR))
        if card_id not in old.cards:
            raise ReportError("NOT_FOUND", f"there is no card {card_id}")
        again = self._pinned({"sql": old.cards[card_id]["sql"]}, None)
        return self._changed(old, actor, now, cards=old.cards | {card_id: old.cards[card_id] | again})

    # -- as tables -----------------------------------------------------------------

    def table(self) -> DataFrame:
        """The latest version of every report that isn't deleted."""
        rows = self.spark.read.schema(STORED).json(f"{self.root}/reports/*/*.json")
        w = Window.partitionBy("id").orderBy(F.desc("version"))
        return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1 AND NOT deleted").drop("__rn", "deleted")

    def snapshot_table(self, most: int = MOST_SNAPSHOTS) -> DataFrame:
        """The latest snapshots of each report, cards as JSON."""
        return latest_snapshots(self.spark.read.schema(SNAPSHOT).json(f"{self.root}/snapshots/*/*.json"), "report_id", "taken_at", "id", most)
