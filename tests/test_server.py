"""The HTTP surface, through a real socket and directly."""

import json
import threading
import urllib.error
import urllib.request

import pytest

from quernel.catalog import STAR
from quernel.plans.decide import Decision, Scripted
from quernel.plans.service import GovernedSql
from quernel.queries.relational import TABLES
from quernel.server import Surface, handle, serve
from quernel.sources import register_tables

SQL = "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus"


@pytest.fixture(scope="module")
def surface(spark, sf, tmp_path_factory):
    register_tables(spark, sf, TABLES)
    base = tmp_path_factory.mktemp("server")
    return Surface(lambda: GovernedSql(spark, STAR, timeout_s=60), str(base / "log"), str(base / "reports"), Scripted([Decision("ANSWER", SQL, ("orders",))]))


@pytest.fixture(scope="module")
def url(surface):
    server = serve(surface, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def call(url, method, path, body=None, actor="ann"):
    r = urllib.request.Request(url + path, None if body is None else json.dumps(body).encode(), {"X-Actor": actor}, method=method)
    try:
        with urllib.request.urlopen(r) as f:
            text = f.read().decode()
            return f.status, json.loads(text) if f.headers["Content-Type"] == "application/json" and text else text
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())


def test_queries_and_runs(url):
    assert call(url, "GET", "/health") == (200, {"status": "ok"})
    status, out = call(url, "POST", "/query", {"sql": SQL, "relations": ["orders"]})
    assert status == 200 and out["outcome"] == "EXECUTED" and out["row_count"] == 3
    assert call(url, "POST", "/query", {"sql": SQL, "relations": []})[1]["reason"] == "UNAUTHORIZED_RELATION"
    assert call(url, "POST", "/query", {"question": "orders by status"})[1]["outcome"] == "EXECUTED"
    assert call(url, "POST", "/query", {})[0] == 422
    runs = call(url, "GET", "/runs")[1]
    assert len(runs) == 3 and {r["runtime_outcome"] for r in runs} == {"EXECUTED", "REJECTED"} and call(url, "GET", "/runs", actor="bob")[1] == []
    run = call(url, "GET", f"/runs/{out['run_id']}")[1]
    assert run["executed_sql"] == SQL and "rows" not in json.loads(run["trace"])
    assert call(url, "GET", "/runs/nothing")[0] == 404


def test_stages_are_streamed(url):
    text = call(url, "POST", "/query/stream", {"sql": SQL, "relations": ["orders"]})[1]
    events = [(e.split("\n")[0][7:], json.loads(e.split("\n")[1][6:])) for e in text.strip().split("\n\n")]
    assert [k for k, _ in events][-1] == "answer" and events[-1][1]["row_count"] == 3
    assert [v["name"] for k, v in events if k == "stage"][0] == "sql_parse" and [v["name"] for k, v in events if k == "stage"][-1] == "execution"


def test_catalog_and_sources(url):
    schema = {t["name"]: t for t in call(url, "GET", "/schema")[1]}
    assert "s_acctbal" not in json.dumps(schema["supplier"]) and schema["orders"]["links"] == ["o_custkey -> customer.c_custkey"]
    assert "sum" in call(url, "GET", "/functions")[1]["aggregate"]
    assert call(url, "GET", "/values/orders/o_orderstatus")[1] == ["F", "O", "P"] and call(url, "GET", "/values/supplier/s_acctbal")[0] == 404
    assert call(url, "POST", "/connections/check", {"kind": "postgresql", "options": {"host": "h"}})[1]["problems"] == ["database is missing", "user is missing"]
    assert {c["kind"] for c in call(url, "GET", "/connectors")[1]} >= {"postgresql", "parquet"}
    assert call(url, "POST", "/explain", {"sql": SQL})[1]["groups"] == ["o_orderstatus"]
    assert call(url, "GET", "/nowhere")[0] == 404


def test_reports(url, surface):
    r = call(url, "POST", "/reports", {"connection_id": "c", "title": "T"})[1]
    path = f"/reports/{r['id']}"
    assert call(url, "GET", path, actor="bob")[0] == 404
    assert call(url, "POST", f"{path}/share", {"visibility": "everyone"})[1]["version"] == 2
    assert call(url, "PUT", path, {"version": 2, "title": "x"}, actor="bob")[0] == 403
    assert call(url, "PUT", path, {"version": 1, "title": "x"})[0] == 409 and call(url, "PUT", path, {"title": "x"})[0] == 422
    assert call(url, "PUT", path, {"version": 2, "cards": {"c1": {"sql": SQL}}})[1]["version"] == 3
    assert json.loads(call(url, "POST", f"{path}/refresh", {}, actor="bob")[1]["cards"])["c1"]["outcome"] == "EXECUTED"
    assert call(url, "POST", f"{path}/schedule", {"every": "daily"})[1]["schedule"] == "daily"
    assert call(url, "POST", f"{path}/accept/c1", {})[0] == 200
    assert [x["id"] for x in call(url, "GET", "/reports", actor="bob")[1]] == [r["id"]]
    assert call(url, "DELETE", path)[0] == 204 and handle(surface, "GET", path, {}, "ann")[0] == 404
