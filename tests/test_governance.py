"""Gates, grain and rewrites on fixed cases, and against independent answers."""

import pytest

from quernel.catalog import STAR, Catalog, Column, Table, changed_tables, compatible, fingerprint
from quernel.plans import grain, rewrite
from quernel.plans.execute import ExecutionError, run_bounded, unique_names
from quernel.plans.parse import ParseFailure, parse, splice
from quernel.plans.service import GovernedSql, QueryPlan
from quernel.queries import governance as G
from quernel.queries.relational import TABLES
from quernel.sources import register_tables


@pytest.fixture(scope="module")
def service(spark, sf):
    register_tables(spark, sf, TABLES)
    return GovernedSql(spark, STAR)


def code(p):
    return "PLANNED" if isinstance(p, QueryPlan) else p.code


@pytest.mark.parametrize(("name", "sql", "want"), G.GATE_CASES, ids=[c[0] for c in G.GATE_CASES])
def test_gates(service, name, sql, want):
    assert code(service.plan(sql)) == want


@pytest.mark.parametrize(("name", "sql", "want"), G.GRAIN_CASES, ids=[c[0] for c in G.GRAIN_CASES])
def test_grain(spark, service, name, sql, want):
    assert grain.validate(spark, STAR, sql).code == want


def test_rejected_fanout_really_differs(spark, service):
    wrong = spark.sql(f"SELECT SUM(o.o_totalprice) FROM {G.OL}").head()[0]
    right = spark.sql("SELECT SUM(o_totalprice) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)").head()[0]
    assert wrong > 2 * right
    assert service.plan(f"SELECT SUM(o.o_totalprice) FROM {G.OL}").code == grain.FANOUT


def test_normalized_equals_reference(spark, service):
    plan = service.plan(G.LEFT_TOTALS)
    want = spark.sql("SELECT o_orderstatus AS status, ROUND(SUM(o_totalprice), 2) AS total, ROUND(SUM(q), 2) AS qty FROM orders LEFT JOIN (SELECT l_orderkey, SUM(l_quantity) AS q FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey GROUP BY o_orderstatus")
    assert plan.changes == ["PRE_AGGREGATED"]
    assert sorted(map(tuple, plan.df.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT SUM(o.o_totalprice), SUM(l.l_quantity) FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey",
        "SELECT SUM(o.o_totalprice), SUM(l.l_quantity) FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE l.l_tax > 0",
        "SELECT SUM(o.o_totalprice), SUM(l.l_quantity), COUNT(*) FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey",
        "SELECT SUM(o.o_totalprice), AVG(l.l_quantity) FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey",
        "SELECT SUM(o.o_totalprice), SUM(l.l_quantity) FROM orders o FULL JOIN lineitem l ON l.l_orderkey = o.o_orderkey",
        "SELECT l.l_returnflag, SUM(o.o_totalprice), SUM(l.l_quantity) FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY l.l_returnflag",
    ],
)
def test_normalizer_abstains(service, sql):
    assert service.plan(sql).code == grain.FANOUT


def test_nulls_last(spark, service):
    f = lambda q: rewrite.nulls_last(spark, q)
    assert f("SELECT o_orderkey FROM orders ORDER BY o_custkey LIMIT 3") == ("SELECT o_orderkey FROM orders ORDER BY o_custkey NULLS LAST LIMIT 3", True)
    assert f("SELECT o_orderkey FROM orders ORDER BY o_custkey ASC, o_orderkey DESC OFFSET 3")[0].count("NULLS LAST") == 1
    for same in (
        "SELECT o_orderkey FROM orders ORDER BY o_custkey",
        "SELECT o_orderkey FROM orders ORDER BY o_custkey DESC LIMIT 3",
        "SELECT o_orderkey FROM orders ORDER BY o_custkey NULLS FIRST LIMIT 3",
        "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY n LIMIT 3",
        "SELECT o_custkey, COUNT(*) FROM orders GROUP BY o_custkey ORDER BY COUNT(*) LIMIT 3",
    ):
        assert f(same) == (same, False)
    ranked = "SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS r FROM orders"
    assert f(ranked)[0].count("NULLS LAST") == 1
    assert f(ranked.replace("row_number", "sum").replace("()", "(o_totalprice)", 1))[1] is False


def test_value_keys_and_check(spark, service):
    assert rewrite.value_key("Value for_Money!") == "valueformoney" and rewrite.value_key("0042") == "42" and rewrite.value_key("000") == "0"
    t = Table("customer", (Column("c_custkey", "bigint", primary_key=True), Column("c_mktsegment", "string", values=("BUILDING", "open", "OPEN"), values_complete=True)))
    cat = Catalog((t,))
    c = rewrite.check_values(spark, cat, "SELECT c_custkey FROM customer x WHERE x.c_mktsegment <> 'Buil ding' AND c_mktsegment IN ('Open', 'nothing', 'open')")
    assert "<> 'BUILDING'" in c.sql and c.changes == [("customer.c_mktsegment", "Buil ding", "BUILDING")]
    assert [u[1] for u in c.unmatched] == ["Open", "nothing"]


def test_probe(service):
    got = service.probe_values([("orders.o_orderpriority", "1 urgent"), ("supplier.s_acctbal", "x")])
    assert got == {("orders.o_orderpriority", "1 urgent"): ["1-URGENT"]}


def test_conditions_and_edits(spark, service):
    sql = "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND NOT (o_totalprice < 10) AND (o_custkey = 1 OR o_custkey = 2) AND o_orderdate >= DATE '1998-01-01'"
    some = rewrite.conditions(parse(spark, sql), sql)
    assert [(c.column, c.removable) for c in some] == [("o_orderstatus", True), ("o_totalprice", False), ("o_custkey", False), ("o_custkey", False), ("o_orderdate", True)]
    new = rewrite.edit_conditions(spark, sql, {0: ["P", "it's"], 4: ["1999-02-03"]})
    assert "IN ('P', 'it\\'s')" in new and "DATE '1999-02-03'" in new and code(service.plan(new)) == "PLANNED"
    assert "TRUE AND NOT" in rewrite.edit_conditions(spark, sql, {}, {0})
    for bad in (({1: ["x"]}, set()), ({0: ["a"]}, set()), ({9: ["a"]}, set()), ({}, {2}), ({4: ["tomorrow"]}, set())):
        with pytest.raises(ValueError):
            rewrite.edit_conditions(spark, sql, *bad)


def test_filters(spark, service):
    f = lambda q: rewrite.filter_table(spark, STAR, q, "orders", "o_orderstatus", ["F"])
    sql, n, skipped = f("SELECT COUNT(*) FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey")
    assert (n, skipped) == (1, 0)
    want = spark.sql("SELECT COUNT(*) FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F'").head()[0]
    assert spark.sql(sql).head()[0] == want
    assert f("SELECT COUNT(*) FROM customer c RIGHT JOIN orders o ON o.o_custkey = c.c_custkey")[1:] == (0, 1)
    assert f("WITH orders AS (SELECT 1 AS x) SELECT x FROM orders")[1:] == (0, 0)
    assert f("SELECT COUNT(*) FROM orders")[0].endswith("AS orders")


def test_tickets_and_bounds(spark, service):
    import copy

    plan = service.plan("SELECT l_orderkey FROM lineitem")
    out = service.execute(plan)
    assert out.row_count == 1000 and out.truncated and out.columns == ["l_orderkey"]
    with pytest.raises(ExecutionError) as e:
        service.execute(copy.copy(plan))
    assert e.value.kind == "PLAN_NOT_ISSUED"


def test_error_classes(spark):
    for sql, kind in [("SELECT 1 / 0", "DIVISION_BY_ZERO"), ("SELECT CAST('x' AS INT)", "INVALID_TEXT_CONVERSION"), ("SELECT 2147483647 + 1", "NUMERIC_OVERFLOW"), ("SELECT (SELECT id FROM range(3))", "MULTIPLE_SUBQUERY_ROWS")]:
        with pytest.raises(ExecutionError) as e:
            run_bounded(spark, spark.sql(f"SELECT * FROM ({sql})"))
        assert e.value.kind == kind


def test_ties_are_of_overall_extremes(spark, service):
    ties = lambda q: rewrite.ties_possible(spark.sql(q))
    assert ties("SELECT p_partkey FROM part WHERE p_size = (SELECT MAX(p_size) FROM part)")
    assert ties("SELECT p_partkey FROM part WHERE (SELECT MIN(p_size) FROM part WHERE p_type = 'x') = p_size AND p_partkey > 1")
    assert ties("SELECT p_partkey FROM (SELECT p_partkey, dense_rank() OVER (ORDER BY p_size) AS r FROM part) x WHERE r <= 1")
    assert not ties("SELECT p_partkey FROM part p WHERE p_size = (SELECT MAX(q.p_size) FROM part q WHERE q.p_brand = p.p_brand)")
    assert not ties("SELECT p_partkey FROM part WHERE p_size = (SELECT MAX(p_size) - 5 FROM part)")
    assert not ties("SELECT p_partkey FROM part WHERE p_size > (SELECT MIN(p_size) FROM part)")
    assert not ties("SELECT p_partkey FROM (SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part) x WHERE r = 1")


def test_many_to_many_joins_are_expensive(spark, service):
    g = GovernedSql(spark, STAR, max_plan_rows=1e6, max_plan_cost=1e7)
    lines = spark.table("lineitem").count()
    assert code(g.plan("SELECT a.l_orderkey FROM lineitem a JOIN lineitem b ON a.l_returnflag = b.l_returnflag")) == "QUERY_TOO_EXPENSIVE"
    assert code(g.plan("SELECT x.l_orderkey FROM (SELECT l_orderkey, l_returnflag AS f FROM lineitem) x JOIN lineitem b ON x.f = b.l_returnflag")) == "QUERY_TOO_EXPENSIVE"
    plan = g.plan("SELECT o.o_orderkey FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey")
    assert isinstance(plan, QueryPlan) and plan.estimate.rows == lines
    assert code(g.plan("SELECT COUNT(*) FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey")) == "PLANNED"


def test_names_of_another_dialect(spark, service):
    plan = service.plan("SELECT strpos(n_name, 'A') AS at, LOCALTIME AS t FROM nation")
    assert plan.sql == "SELECT instr(n_name, 'A') AS at, current_time() AS t FROM nation"
    assert code(service.plan("SELECT md5(n_name) FROM nation")) == "FORBIDDEN_FUNCTION"


def test_timeout(spark):
    slow = spark.sql("SELECT COUNT(*) FROM range(1000000) a CROSS JOIN range(1000000) b WHERE a.id * b.id = 7")
    with pytest.raises(ExecutionError) as e:
        run_bounded(spark, slow, timeout_s=1.0)
    assert e.value.kind == "STATEMENT_TIMEOUT"
    assert spark.range(3).count() == 3


def test_names_splices_fingerprints(spark):
    assert unique_names(["sum", "sum", "sum_2", "SUM"]) == ["sum", "sum_3", "sum_2", "SUM_4"] or len({n.lower() for n in unique_names(["sum", "sum", "sum_2", "SUM"])}) == 4
    assert splice("abcdef", [(1, 2, "X"), (4, 4, "-")]) == "aXcd-ef"
    with pytest.raises(ValueError):
        splice("abc", [(0, 2, "x"), (1, 3, "y")])
    with pytest.raises(ParseFailure):
        parse(spark, "SELECT 1;; SELECT 2")
    saved = {t.name: fingerprint(t) for t in STAR.tables}
    assert changed_tables(saved, STAR) == [] and changed_tables(saved, STAR.without_links()) == ["customer", "lineitem", "nation", "orders", "supplier"]
    assert compatible("date", "timestamp") and compatible("varchar(3)", "text") and not compatible("date", "text") and compatible("uuid", "UUID")
    assert compatible("int", "decimal(3,1)") and compatible("int", "bigint") and not compatible("int", "string")
