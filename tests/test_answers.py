import json

import pytest

from quernel.catalog import STAR, Catalog, Column, Relationship, Table
from quernel.plans import context as C
from quernel.plans.decide import Budget, Decision, Scripted, answer, replay, thread
from quernel.plans.service import GovernedSql
from quernel.queries.relational import TABLES
from quernel.sources import ParquetSource, register_tables
from quernel.sources.audit import append_events, append_run, read_runs
from quernel.sources.connectors import classify_error, validate_options
from quernel.streaming import tumbling_counts


@pytest.fixture
def service(spark, sf):
    register_tables(spark, sf, TABLES)
    return GovernedSql(spark, STAR, timeout_s=60)


OK = Decision("ANSWER", "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus", ("orders",))


def test_answer(service):
    a = answer(service, Scripted([OK]), "orders by status")
    assert a.outcome == "EXECUTED" and a.result.row_count == 3
    names = [s["name"] for s in service.trace.stages]
    assert names[:2] == ["sql_parse", "global_policy"] and names[-1] == "execution"


def test_repair_once(service):
    bad = Decision("ANSWER", "SELECT nothing FROM orders", ("orders",))
    s = Scripted([bad, OK])
    assert answer(service, s, "q").outcome == "EXECUTED" and s.seen[1][0].startswith("UNKNOWN_COLUMN")
    assert answer(service, Scripted([bad, bad, OK]), "q").reason == "UNKNOWN_COLUMN"


def test_not_repairable_and_blocked(service):
    assert answer(service, Scripted([Decision("ANSWER", "SELECT c_name FROM customer", ("orders",))]), "q").reason == "UNAUTHORIZED_RELATION"
    assert answer(service, Scripted([Decision("BLOCKED_POLICY")]), "q").outcome == "BLOCKED_POLICY"
    assert answer(service, Scripted([Decision("NEEDS_CLARIFICATION", question="which?")]), "q").question == "which?"
    assert answer(service, Scripted([Decision("ANSWER")]), "q").outcome == "INVALID_PROPOSAL"


def test_explore_and_budget(service):
    probe = Decision("EXPLORE", probes=("SELECT COUNT(*) AS n FROM orders",))
    s = Scripted([probe, OK])
    assert answer(service, s, "q").outcome == "EXECUTED" and s.seen[1][0].startswith("PROBE 1 rows; n 1 distinct 0 null\n")
    assert answer(service, Scripted([probe]), "q").outcome == "BUDGET_EXHAUSTED"
    clock = iter([0.0, 0.0, 500.0])
    assert answer(service, Scripted([probe]), "q", Budget(clock=lambda: next(clock, 500.0))).outcome == "BUDGET_EXHAUSTED"


def test_empty_result_is_respelled(service):
    a = replay(service, "SELECT COUNT(o_orderkey) AS n FROM orders WHERE o_orderpriority = '1 urgent'", {"orders"})
    assert a.outcome == "EXECUTED" and "RESPELLED" in a.notes and a.result.rows[0]["n"] > 0


def test_readings_and_ties(service):
    other = "SELECT o_orderstatus, COUNT(*) + 1 AS n FROM orders GROUP BY o_orderstatus"
    assert answer(service, Scripted([Decision("ANSWER", OK.sql, ("orders",), readings=(other,))]), "q").reason == "READINGS_DIFFER"
    assert answer(service, Scripted([Decision("ANSWER", OK.sql, ("orders",), readings=(OK.sql,))]), "q").outcome == "EXECUTED"
    tied = "SELECT p_partkey FROM part WHERE p_size = (SELECT MAX(p_size) FROM part)"
    a = replay(service, tied, {"part"})
    assert ("TIES" in a.notes) == (a.result.row_count > 1)


def test_probes_run_under_the_requests_authority(service):
    probe = Decision("EXPLORE", probes=("SELECT COUNT(*) AS n FROM customer",))
    s = Scripted([probe, OK])
    assert answer(service, s, "q", allowed={"orders"}).outcome == "EXECUTED" and s.seen[1] == ["PROBE UNAUTHORIZED_RELATION"]


def test_shared_rows_and_respelled_probes(service):
    shared = frozenset({("orders", "o_orderpriority")})
    s = Scripted([Decision("EXPLORE", probes=("SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority = '1 urgent'", "SELECT o_orderkey FROM orders LIMIT 1")), OK])
    answer(service, s, "q", shared=shared)
    assert s.seen[1][0] == "PROBE 1 rows; o_orderpriority 1 distinct 0 null\n1-URGENT; RESPELLED" and s.seen[1][1] == "PROBE 1 rows; o_orderkey 1 distinct 0 null"


def test_look_first_once(service):
    ask = Decision("NEEDS_CLARIFICATION", question="which?")
    s = Scripted([ask, OK])
    assert answer(service, s, "q").outcome == "EXECUTED" and s.seen[1][0].startswith("LOOK_FIRST: NEEDS_CLARIFICATION")
    s = Scripted([ask])
    assert answer(service, s, "q").question == "which?" and len(s.seen) == 2
    s = Scripted([ask])
    assert answer(service, s, "q", Budget(explore_rounds=0)).outcome == "NEEDS_CLARIFICATION" and len(s.seen) == 1


def test_readings_of_a_clarification(service):
    same = Decision("NEEDS_CLARIFICATION", question="which?", readings=(OK.sql, OK.sql.replace("COUNT(*)", "COUNT(o_orderkey)")))
    assert "READINGS_AGREE" in answer(service, Scripted([same]), "q").notes
    other = Decision("NEEDS_CLARIFICATION", question="which?", readings=(OK.sql, OK.sql.replace("COUNT(*)", "MAX(o_orderkey)")))
    assert answer(service, Scripted([other]), "q").outcome == "NEEDS_CLARIFICATION"
    a = answer(service, Scripted([other]), "q", mode="assume")
    assert a.outcome == "EXECUTED" and "READING_ASSUMED" in a.notes and len(a.alternatives) == 1 and a.alternatives[0][1].row_count == 3
    assert answer(service, Scripted([other]), "q", Budget(queries=1), mode="assume").outcome == "NEEDS_CLARIFICATION"


def test_tokens_end_a_run(service):
    spent = Decision("EXPLORE", probes=(OK.sql,), tokens=100)
    assert answer(service, Scripted([spent]), "q", Budget(tokens=150)).reason == "BUDGET_TOKENS"
    s = Scripted([Decision("EXPLORE", probes=(OK.sql, OK.sql)), OK])
    answer(service, s, "q", Budget(queries=1))
    assert s.seen[1][1] == "PROBE BUDGET_PROBE_QUERIES"


def test_a_run_is_logged(service, tmp_path):
    seen = []
    answer(service, Scripted([OK]), "orders?", log=seen.append, about={"actor": "ann"})
    assert seen[0]["actor"] == "ann" and seen[0]["model_decision"] == "ANSWER" and seen[0]["row_count"] == 3 and len(seen[0]["model_context_hash"]) == 64
    assert "rows" not in seen[0] and seen[0]["trace"]["stages"][-1]["name"] == "execution"
    append_run(service.spark, str(tmp_path / "log"), seen[0])
    assert read_runs(service.spark, str(tmp_path / "log")).head()["runtime_outcome"] == "EXECUTED"


def test_context_expansion(service, monkeypatch):
    monkeypatch.setattr(C, "WHOLE", 3)
    monkeypatch.setattr(C, "NEIGHBOURS", 0)
    s = Scripted([Decision("BLOCKED_AUTHORITY", relations=("events",)), Decision("ANSWER", "SELECT COUNT(*) AS n FROM events", ("events",))])
    seen = []
    service.trace.listener = seen.append
    a = answer(service, s, "nations of a region")
    assert a.outcome == "EXECUTED" and s.seen[1] == ["CONTEXT_EXPANDED: events"] and [x["name"] for x in seen][-1] == "execution"
    assert answer(service, Scripted([Decision("BLOCKED_AUTHORITY", relations=("orders",))]), "orders").outcome == "BLOCKED_AUTHORITY"


def test_context():
    tables = tuple(Table(f"t{i:02d}", (Column("id", "int", primary_key=True), *(Column(f"c{k}", "string") for k in range(12))), f"about thing{i}", relationships=(Relationship("c0", f"t{i - 1:02d}", "id"),) if i else ()) for i in range(20))
    cat = Catalog(tables)
    ctx = C.select(cat, "show thing3 and thing5")
    names = [t.name for t in ctx.tables]
    assert {"t03", "t04", "t05"} <= set(names) and len(names) <= C.MOST_TABLES + C.NEIGHBOURS and "t19" in ctx.omitted
    assert all(len(t.columns) <= C.MOST_COLUMNS for t in ctx.tables)
    assert C.shortest_path(C.neighbours(cat), "t03", "t05") == ["t03", "t04", "t05"] and C.shortest_path(C.neighbours(cat), "t00", "t09") is None
    one, two = C.render(C.select(STAR, "orders"), STAR), C.render(C.select(STAR, "orders"), STAR)
    assert one == two and "s_acctbal" not in one["json"] and json.loads(one["json"])["relationships"]


def test_sources(spark, sf):
    p = ParquetSource(sf)
    assert p.test(spark) == (True, None) and ("orders", "o_orderkey", "bigint", True) in p.introspect(spark)
    assert ParquetSource("/nowhere/at/all").test(spark)[1] == "not_found"
    assert validate_options("postgresql", {"host": "h", "database": "d", "user": "u"})[0]["port"] == 5432
    assert validate_options("postgresql", {"port": "x", "odd": 1})[1] == ["unknown field odd", "host is missing", "port is no port", "database is missing", "user is missing"]
    assert classify_error("FATAL: password authentication failed").kind == "bad_credentials" and classify_error("hm").kind == "other"


def test_audit(spark, tmp_path):
    path = str(tmp_path / "log")
    append_run(spark, path, {"run_id": "1", "question": "q", "trace": {"stages": []}})
    append_run(spark, path, {"run_id": "2", "row_count": 3})
    assert read_runs(spark, path).count() == 2
    with pytest.raises(ValueError):
        append_run(spark, path, {"run_id": "3", "rows": [1]})
    hashes = append_events(spark, str(tmp_path / "ev"), [{"a": 1}, {"a": 1}])
    assert len(set(hashes)) == 2
    with pytest.raises(ValueError):
        append_events(spark, str(tmp_path / "ev"), [{"a": [{"password": "x"}]}])


def test_thread():
    runs = {"a": {}, "b": {"follow_up_of": "a"}, "c": {"edited_from": "b"}, "x": {"follow_up_of": "x"}}
    assert thread(runs, "c") == ["a", "b", "c"] and thread(runs, "x") == ["x"]


def test_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = tumbling_counts(stream, "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, tumbling_counts(events, "ts", "event_type").collect()))
