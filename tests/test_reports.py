"""Reports and database sources."""

import json
from datetime import datetime, timedelta

import pytest

from quernel.catalog import STAR
from quernel.plans.reports import MOST_SNAPSHOTS, Report, ReportError, Reports
from quernel.plans.service import GovernedSql
from quernel.queries.relational import TABLES
from quernel.sources import register_tables
from quernel.sources.database import COLUMNS, KEYS, LINKS, DatabaseSource

NOW = datetime(2026, 1, 5, 8)
SQL = "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority"


@pytest.fixture
def reports(spark, sf, tmp_path):
    register_tables(spark, sf, TABLES)
    return Reports(spark, str(tmp_path / "store"), GovernedSql(spark, STAR, timeout_s=60))


def code(f, *args, **kwargs):
    with pytest.raises(ReportError) as e:
        f(*args, **kwargs)
    return e.value.code


def test_roles_and_versions(reports):
    r = reports.create("Ann", "governed", " Sales ", NOW)
    assert (r.title, r.version, r.role("ANN "), r.role("bob")) == ("Sales", 1, "owner", None)
    assert code(reports.get, r.id, "bob") == "NOT_FOUND" and code(reports.create, "a", "c", " ", NOW) == "REJECTED"
    reports.share(r.id, "ann", NOW, "private", ("Bob",), ("cleo",))
    assert code(reports.update, r.id, "cleo", 2, NOW, title="x") == "FORBIDDEN" and code(reports.share, r.id, "bob", NOW, "everyone") == "FORBIDDEN"
    new = reports.update(r.id, "bob", 2, NOW, title="Sales 2", cards={"c1": {"sql": SQL}, "t": {"note": "text"}})
    assert new.version == 3 and set(new.cards["c1"]["basis"]) == {"orders"}
    assert code(reports.update, r.id, "ann", 2, NOW, title="late") == "CONFLICT"
    assert code(reports._save, new) == "CONFLICT"  # two writers of one version
    assert code(reports.update, r.id, "ann", 3, NOW, cards={"c": {"sql": "SELECT s_acctbal FROM supplier"}}) == "REJECTED"
    assert code(reports.update, r.id, "ann", 3, NOW, filters=({"table": "orders", "column": "nothing"},)) == "REJECTED"
    assert [x.id for x in reports.all("cleo")] == [r.id] and reports.all("dora") == []
    assert [(x["id"], x["version"], x["title"]) for x in reports.table().collect()] == [(r.id, 3, "Sales 2")]
    reports.delete(r.id, "ann", NOW)
    assert code(reports.get, r.id, "ann") == "NOT_FOUND" and reports.table().count() == 0


def test_schedule_is_claimed_once(reports):
    r = reports.create("ann", "governed", "Daily", NOW)
    r = reports.update(r.id, "ann", 1, NOW, cards={"c1": {"sql": SQL}}, filters=({"table": "orders", "column": "o_orderstatus", "values": ["F"]},))
    r = reports.schedule(r.id, "ann", NOW, "daily")
    assert code(reports.schedule, r.id, "ann", NOW, "sometimes") == "REJECTED"
    assert reports.run_due(NOW) == []
    later = NOW + timedelta(days=3, hours=1)
    assert len(reports.run_due(later)) == 1 and reports.run_due(later) == [] and not reports.claim(r, later)
    assert reports.get(r.id, "ann").next_refresh_at == (NOW + timedelta(days=4)).isoformat()
    snap = json.loads(reports.snapshot_table().head()["cards"])["c1"]
    want = reports.spark.sql("SELECT COUNT(*) FROM orders WHERE o_orderstatus = 'F'").head()[0]
    assert snap["outcome"] == "EXECUTED" and sum(x["n"] for x in snap["rows"]) == want and snap["changed"] == []


def test_snapshots_are_kept_up_to_a_number(reports):
    r = reports.create("ann", "governed", "Empty", NOW)
    for i in range(MOST_SNAPSHOTS + 3):
        reports.snapshot(r, "ann", NOW + timedelta(minutes=i), False)
    rows = reports.snapshot_table().collect()
    assert len(rows) == MOST_SNAPSHOTS and min(x["taken_at"] for x in rows) == (NOW + timedelta(minutes=3)).isoformat()


def test_accepting_a_changed_basis(reports):
    r = reports.create("ann", "governed", "Basis", NOW)
    r = reports.update(r.id, "ann", 1, NOW, cards={"c1": {"sql": SQL}})
    stale = reports._changed(r, "ann", NOW, cards={"c1": r.cards["c1"] | {"basis": {"orders": "0" * 16}}})
    assert json.loads(reports.refresh(stale.id, "ann", NOW)["cards"])["c1"]["changed"] == ["orders"]
    kept = reports.update(r.id, "ann", 3, NOW, cards={"c1": {"sql": SQL, "title": "t"}})  # saving doesn't accept
    assert kept.cards["c1"]["basis"] == {"orders": "0" * 16}
    assert reports.accept(r.id, "ann", NOW, "c1").cards["c1"]["basis"] == r.cards["c1"]["basis"]
    assert code(reports.accept, r.id, "ann", NOW, "c9") == "NOT_FOUND"


def test_everyone_may_look():
    r = Report("r", "c", "t", "ann", "now", visibility="everyone")
    assert r.role("zoe") == "viewer" and r.role("ann") == "owner"


def fake(spark):
    """A database of two tables in the form of its information schema."""
    frames = {
        COLUMNS: spark.createDataFrame([("o", "id", "integer", "NO", 1), ("o", "c_id", "integer", "YES", 2), ("c", "kind", "text", "YES", 2), ("c", "id", "integer", "NO", 1)], "t string, c string, k string, n string, p int"),
        KEYS: spark.createDataFrame([("o", "id", "o_pk", "PRIMARY KEY"), ("c", "id", "c_pk", "PRIMARY KEY"), ("c", "id", "c_both", "UNIQUE"), ("c", "kind", "c_both", "UNIQUE")], "t string, c string, n string, k string"),
        LINKS: spark.createDataFrame([("o", "c_id", "c", "id")], "t string, c string, r string, rc string"),
    }
    rows = {"o": spark.createDataFrame([(1, 1), (2, 1), (3, 9), (4, None)], "id int, c_id int"), "c": spark.createDataFrame([(1, "a"), (2, None)], "id int, kind string")}

    def read(sql):
        for k, df in frames.items():
            if sql == k.format(schema="public", where=""):
                return df
        if "reltuples" in sql:
            return spark.createDataFrame([("o", 4.0), ("c", -1.0)], "r string, n double")
        some, _, name = sql.removeprefix("SELECT ").partition(" FROM public.")
        return rows[name].select(*some.split(", "))

    return read


def test_database(spark):
    db = DatabaseSource("postgresql", {"host": "h", "database": "d", "user": "u"}, fake(spark))
    assert db.test() == (True, None) and db.queryable and not DatabaseSource("mysql", {}, None).queryable
    assert db.introspect() == [("c", "id", "integer", False), ("c", "kind", "text", True), ("o", "id", "integer", False), ("o", "c_id", "integer", True)]
    assert db.unique_keys() == {"o": {"id"}, "c": {"id"}}
    cat = db.catalog()
    assert cat.table("o").key == {"id"} and cat.table("o").relationships[0].target == "c" and frozenset({("o", "c_id"), ("c", "id")}) in cat.edges
    assert db.has_duplicates("o", "c_id") and not db.has_duplicates("c", "id") and db.match_rate("o", "c_id", "c", "id") == round(2 / 3, 4)
    assert db.row_estimates() == {"o": 4.0, "c": 0.0}
    stats = {r["column"]: (r["null_share"], r["complete"], r["values"]) for r in db.column_stats("c", ["id", "kind"]).collect()}
    assert stats == {"id": (0.0, True, "1|2"), "kind": (0.5, True, "a")}

    def broken(sql):
        raise RuntimeError("FATAL: password authentication failed")

    assert DatabaseSource("postgresql", {}, broken).test() == (False, "bad_credentials")


def test_drivers(spark):
    from quernel.sources.connectors import CONNECTORS
    from quernel.sources.database import ADDRESSES, DRIVERS, missing_driver

    assert set(DRIVERS) == set(ADDRESSES) == set(CONNECTORS) - {"parquet"}
    assert missing_driver(spark, "mysql") == "com.mysql:mysql-connector-j"
