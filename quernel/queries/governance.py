"""Verdicts of the gates on fixed cases, and what the rewrites make of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.catalog import STAR, Catalog, Column, Table
from quernel.plans import grain, rewrite
from quernel.plans.service import GovernedSql, QueryPlan, spellings
from quernel.queries.relational import SQL_PAIRS, TABLES
from quernel.sources import read_table, register_tables

J = "orders o JOIN customer c ON o.o_custkey = c.c_custkey"
OL = "orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey"

# name, query, verdict
GATE_CASES: list[tuple[str, str, str]] = [
    ("plain select", "SELECT o_orderkey FROM orders", "PLANNED"),
    ("schema public", "SELECT o_orderkey FROM public.orders", "PLANNED"),
    ("two statements", "SELECT 1; SELECT 2", "SQL_PARSE_ERROR"),
    ("empty", "  ", "SQL_PARSE_ERROR"),
    ("broken", "SELECT o_orderkey FROM orders WHERE (", "SQL_PARSE_ERROR"),
    ("insert", "INSERT INTO orders SELECT * FROM orders", "NON_READ_ONLY_STATEMENT"),
    ("drop", "DROP TABLE orders", "NON_READ_ONLY_STATEMENT"),
    ("create", "CREATE TABLE x AS SELECT 1", "NON_READ_ONLY_STATEMENT"),
    ("set", "SET spark.sql.shuffle.partitions = 1", "NON_READ_ONLY_STATEMENT"),
    ("describe", "DESCRIBE orders", "NON_READ_ONLY_STATEMENT"),
    ("explain", "EXPLAIN SELECT 1", "NON_READ_ONLY_STATEMENT"),
    ("cache", "CACHE TABLE orders", "NON_READ_ONLY_STATEMENT"),
    ("add jar", "ADD JAR 'x.jar'", "NON_READ_ONLY_STATEMENT"),
    ("sample", "SELECT * FROM orders TABLESAMPLE (10 PERCENT)", "NON_READ_ONLY_STATEMENT"),
    ("recursive", "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 5) SELECT n FROM r", "NON_READ_ONLY_STATEMENT"),
    ("file as table", "SELECT * FROM parquet.`/tmp/x`", "FORBIDDEN_TABLE"),
    ("system catalog", "SELECT * FROM information_schema.tables", "FORBIDDEN_CATALOG"),
    ("global temp", "SELECT * FROM global_temp.orders", "FORBIDDEN_CATALOG"),
    ("no such table", "SELECT x FROM payments", "UNKNOWN_TABLE"),
    ("no such table inside", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM payments)", "UNKNOWN_TABLE"),
    ("cte shadows nothing", "WITH payments AS (SELECT o_orderkey AS x FROM orders) SELECT x FROM payments", "PLANNED"),
    ("cte out of scope", "SELECT a.x FROM (WITH p AS (SELECT 1 AS x) SELECT x FROM p) a JOIN p ON TRUE", "UNKNOWN_TABLE"),
    ("random", "SELECT rand() FROM orders", "FORBIDDEN_FUNCTION"),
    ("uuid", "SELECT uuid()", "FORBIDDEN_FUNCTION"),
    ("java", "SELECT java_method('java.util.UUID', 'randomUUID')", "FORBIDDEN_FUNCTION"),
    ("regex operator", "SELECT o_orderkey FROM orders WHERE o_orderpriority RLIKE '1.*'", "FORBIDDEN_FUNCTION"),
    ("regex function", "SELECT regexp_replace(o_orderpriority, 'a', 'b') FROM orders", "FORBIDDEN_FUNCTION"),
    ("hash", "SELECT md5(c_name) FROM customer", "FORBIDDEN_FUNCTION"),
    ("cume_dist", "SELECT cume_dist() OVER (ORDER BY o_orderkey) FROM orders", "FORBIDDEN_FUNCTION"),
    ("table function", "SELECT * FROM range(10)", "FORBIDDEN_FUNCTION"),
    ("file name", "SELECT input_file_name() FROM orders", "FORBIDDEN_FUNCTION"),
    ("no such function", "SELECT frobnicate(o_orderkey) FROM orders", "FORBIDDEN_FUNCTION"),
    ("no such column", "SELECT o_nothing FROM orders", "UNKNOWN_COLUMN"),
    ("ambiguous column", "SELECT n_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey", "UNKNOWN_COLUMN"),
    ("hidden column", "SELECT s_acctbal FROM supplier", "FORBIDDEN_COLUMN"),
    ("hidden by star", "SELECT * FROM supplier", "FORBIDDEN_COLUMN"),
    ("hidden by alias star", "SELECT s.* FROM supplier s", "FORBIDDEN_COLUMN"),
    ("hidden in filter", "SELECT s_name FROM supplier WHERE s_acctbal > 0", "FORBIDDEN_COLUMN"),
    ("hidden in cte", "WITH x AS (SELECT s_acctbal AS a FROM supplier) SELECT a FROM x", "FORBIDDEN_COLUMN"),
    ("hidden in subquery", "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)", "FORBIDDEN_COLUMN"),
    ("count star of it", "SELECT COUNT(*) FROM supplier", "PLANNED"),
    ("declared link", f"SELECT c.c_name, o.o_orderkey FROM {J}", "PLANNED"),
    ("link in where", "SELECT c.c_name FROM orders o, customer c WHERE o.o_custkey = c.c_custkey", "PLANNED"),
    ("same values only", "SELECT c.c_name FROM events e JOIN customer c ON e.user_id = c.c_custkey", "UNAUTHORIZED_JOIN"),
    ("wrong columns", "SELECT c.c_name FROM orders o JOIN customer c ON o.o_orderkey = c.c_custkey", "UNAUTHORIZED_JOIN"),
    ("cross join", "SELECT o.o_orderkey FROM orders o CROSS JOIN customer c", "UNAUTHORIZED_JOIN"),
    ("on true", "SELECT o.o_orderkey FROM orders o JOIN customer c ON TRUE", "UNAUTHORIZED_JOIN"),
    ("comma list", "SELECT o.o_orderkey FROM orders o, customer c", "UNAUTHORIZED_JOIN"),
    ("only a range", "SELECT o.o_orderkey FROM orders o JOIN customer c ON o.o_totalprice > c.c_acctbal", "UNAUTHORIZED_JOIN"),
    ("range beside a link", "SELECT o.o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal", "PLANNED"),
    ("link under or", "SELECT o.o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey OR o.o_orderkey = 1", "UNAUTHORIZED_JOIN"),
    ("or of one link", "SELECT o.o_orderkey FROM orders o JOIN customer c ON (o.o_custkey = c.c_custkey AND c.c_acctbal > 0) OR (o.o_custkey = c.c_custkey AND c.c_acctbal < -10)", "PLANNED"),
    ("equality once linked", "SELECT o.o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice = c.c_acctbal", "PLANNED"),
    ("two links to one key", "SELECT COUNT(*) FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey", "PLANNED"),
    ("traced link", "WITH x AS (SELECT o_custkey AS k FROM orders) SELECT c.c_name FROM x JOIN customer c ON x.k = c.c_custkey", "PLANNED"),
    ("traced wrong link", "WITH x AS (SELECT o_orderkey AS k FROM orders) SELECT c.c_name FROM x JOIN customer c ON x.k = c.c_custkey", "UNAUTHORIZED_JOIN"),
    ("traced through casts", "SELECT c.c_name FROM (SELECT CAST(user_id AS BIGINT) AS k FROM (SELECT * FROM events) e) x JOIN customer c ON x.k = c.c_custkey", "UNAUTHORIZED_JOIN"),
    ("one row derived", "SELECT c.c_name FROM customer c CROSS JOIN (SELECT AVG(c_acctbal) AS m FROM customer) x WHERE c.c_acctbal > x.m", "PLANNED"),
    ("self join", "SELECT a.n_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey = 1", "PLANNED"),
    ("exists link", "SELECT c.c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)", "PLANNED"),
    ("exists wrong link", "SELECT c.c_name FROM customer c WHERE EXISTS (SELECT 1 FROM events e WHERE e.user_id = c.c_custkey)", "UNAUTHORIZED_JOIN"),
    ("three unlinked", "SELECT o.o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN part p ON TRUE", "UNAUTHORIZED_JOIN"),
]

# name, query, verdict of the grain validator
GRAIN_CASES: list[tuple[str, str, str]] = [
    ("parent alone", "SELECT o_orderstatus, SUM(o_totalprice) FROM orders GROUP BY o_orderstatus", "PASS"),
    ("parent with its parent", f"SELECT c.c_mktsegment, SUM(o.o_totalprice) FROM {J} GROUP BY c.c_mktsegment", "PASS"),
    ("no measure", f"SELECT COUNT(*), MAX(o.o_totalprice) FROM {OL}", "NOT_APPLICABLE"),
    ("sum over lines", f"SELECT o.o_orderstatus, SUM(o.o_totalprice) FROM {OL} GROUP BY o.o_orderstatus", "PARENT_MEASURE_FANOUT"),
    ("left join lines", "SELECT SUM(o.o_totalprice) FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey", "PARENT_MEASURE_FANOUT"),
    ("comma join lines", "SELECT SUM(o.o_totalprice) FROM orders o, lineitem l WHERE l.l_orderkey = o.o_orderkey", "PARENT_MEASURE_FANOUT"),
    ("sum of lines", f"SELECT o.o_orderstatus, SUM(l.l_extendedprice) FROM {OL} GROUP BY o.o_orderstatus", "PASS"),
    ("average over lines", f"SELECT AVG(o.o_totalprice) FROM {OL}", "PARENT_MEASURE_FANOUT"),
    ("average by parent key", f"SELECT o.o_orderkey, AVG(o.o_totalprice) FROM {OL} GROUP BY o.o_orderkey", "PASS"),
    ("sum by parent key", f"SELECT o.o_orderkey, SUM(o.o_totalprice) FROM {OL} GROUP BY o.o_orderkey", "PARENT_MEASURE_FANOUT"),
    ("distinct mask", f"SELECT SUM(DISTINCT o.o_totalprice) FROM {OL}", "DISTINCT_VALUE_FANOUT_MASK"),
    ("expression", f"SELECT SUM(o.o_totalprice * 2) FROM {OL}", "PARENT_MEASURE_FANOUT"),
    ("case", f"SELECT SUM(CASE WHEN l.l_returnflag = 'R' THEN o.o_totalprice END) FROM {OL}", "PARENT_MEASURE_FANOUT"),
    ("grandparent", "SELECT SUM(c.c_acctbal) FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey", "PARENT_MEASURE_FANOUT"),
    ("two levels", "SELECT SUM(c.c_acctbal) FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey", "PARENT_MEASURE_FANOUT"),
    ("pre-aggregated child", "SELECT SUM(o.o_totalprice) FROM orders o JOIN (SELECT l_orderkey, SUM(l_quantity) AS q FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey", "PASS"),
    ("grouped too finely", "SELECT SUM(o.o_totalprice) FROM orders o JOIN (SELECT l_orderkey, l_partkey, SUM(l_quantity) AS q FROM lineitem GROUP BY l_orderkey, l_partkey) l ON l.l_orderkey = o.o_orderkey", "PARENT_MEASURE_FANOUT"),
    ("distinct child key", "SELECT SUM(o.o_totalprice) FROM orders o JOIN (SELECT DISTINCT l_orderkey FROM lineitem) l ON l.l_orderkey = o.o_orderkey", "PASS"),
    ("semi join", "SELECT SUM(o.o_totalprice) FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)", "PASS"),
    ("in subquery", "SELECT SUM(o_totalprice) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)", "PASS"),
    ("through cte", f"WITH x AS (SELECT o.o_totalprice AS t, l.l_partkey AS p FROM {OL}) SELECT p, SUM(t) FROM x GROUP BY p", "PARENT_MEASURE_FANOUT"),
    ("through derived", f"SELECT SUM(t) FROM (SELECT o.o_totalprice AS t FROM {OL}) x", "PARENT_MEASURE_FANOUT"),
    ("deduplicated", f"SELECT SUM(t) FROM (SELECT DISTINCT o.o_orderkey AS k, o.o_totalprice AS t FROM {OL}) x", "PASS"),
    ("regrouped by key", f"SELECT SUM(t) FROM (SELECT o.o_orderkey AS k, MAX(o.o_totalprice) AS t FROM {OL} GROUP BY o.o_orderkey) x", "NOT_APPLICABLE"),
    ("lines of both siblings", "SELECT SUM(l.l_quantity) FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN orders o ON l.l_orderkey = o.o_orderkey", "PASS"),
    ("part over lines", "SELECT SUM(p.p_retailprice) FROM part p JOIN lineitem l ON l.l_partkey = p.p_partkey", "PARENT_MEASURE_FANOUT"),
    ("window total", "SELECT o_orderkey, SUM(o_totalprice) OVER (PARTITION BY o_custkey) FROM orders", "NOT_APPLICABLE"),
    ("using", "SELECT SUM(t) FROM (SELECT o_orderkey AS k, o_totalprice AS t FROM orders) a JOIN (SELECT l_orderkey AS k FROM lineitem) b USING (k)", "PARENT_MEASURE_FANOUT"),
    ("one row cross", "SELECT SUM(o.o_totalprice) FROM orders o CROSS JOIN (SELECT COUNT(*) AS n FROM lineitem) x", "PASS"),
    ("exploded", "SELECT SUM(p_retailprice) FROM part LATERAL VIEW explode(split(p_type, ' ')) w AS word", "PARENT_MEASURE_FANOUT"),
    ("second child", "SELECT SUM(l.l_quantity) FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN lineitem m ON m.l_orderkey = o.o_orderkey", "PARENT_MEASURE_FANOUT"),
]

AUTHORITY_CASES: list[tuple[str, str, list[str] | None, bool, str]] = [
    ("inside", f"SELECT c.c_name FROM {J}", ["orders", "customer"], True, "PLANNED"),
    ("beyond", f"SELECT c.c_name FROM {J}", ["orders"], True, "UNAUTHORIZED_RELATION"),
    ("none given", "SELECT o_orderkey FROM orders", None, True, "MISSING_REQUEST_AUTHORITY"),
    ("internal", "SELECT o_orderkey FROM orders", None, False, "PLANNED"),
]

LEFT_TOTALS = "SELECT o.o_orderstatus AS status, ROUND(SUM(o.o_totalprice), 2) AS total, ROUND(SUM(l.l_quantity), 2) AS qty FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderstatus"
REPORT = "SELECT o.o_orderpriority AS priority, COUNT(*) AS n_orders, COUNT(li.q) AS with_lines FROM orders o LEFT JOIN (SELECT l_orderkey, SUM(l_quantity) AS q FROM lineitem GROUP BY l_orderkey) li ON li.l_orderkey = o.o_orderkey GROUP BY o.o_orderpriority"


def _values(rows: list[tuple], names: str) -> str:
    quoted = ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {quoted}) AS t({names})"


def _service(spark: SparkSession, base: str, catalog: Catalog = STAR) -> GovernedSql:
    register_tables(spark, base, TABLES)
    return GovernedSql(spark, catalog, max_plan_rows=1e12, max_plan_cost=1e12)


def _verdicts(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "name string, verdict string")


def gate_verdicts(spark: SparkSession, base: str) -> DataFrame:
    """The verdict of all gates on each fixed case."""
    g = _service(spark, base)
    plans = [(n, g.plan(q)) for n, q, _ in GATE_CASES]
    return _verdicts(spark, [(n, "PLANNED" if isinstance(p, QueryPlan) else p.code) for n, p in plans])


def grain_verdicts(spark: SparkSession, base: str) -> DataFrame:
    """The grain validator's verdict on each fixed case."""
    register_tables(spark, base, TABLES)
    return _verdicts(spark, [(n, grain.validate(spark, STAR, q).code) for n, q, _ in GRAIN_CASES])


def authority_verdicts(spark: SparkSession, base: str) -> DataFrame:
    """Relations outside the request are refused."""
    g = _service(spark, base)
    plans = [(n, g.plan(q, set(e) if e is not None else None, m)) for n, q, e, m, _ in AUTHORITY_CASES]
    return _verdicts(spark, [(n, "PLANNED" if isinstance(p, QueryPlan) else p.code) for n, p in plans])


def cost_verdicts(spark: SparkSession, base: str) -> DataFrame:
    """The cost gate's verdict on a plain and an exploding query."""
    register_tables(spark, base, TABLES)
    g = GovernedSql(spark, STAR, max_plan_rows=1e6, max_plan_cost=1e7)
    cases = [("scan", "SELECT o_orderkey FROM orders"), ("self theta", "SELECT a.l_orderkey FROM lineitem a JOIN lineitem b ON a.l_quantity < b.l_quantity")]
    return _verdicts(spark, [(n, "PLANNED" if isinstance(p := g.plan(q), QueryPlan) else p.code) for n, q in cases])


def grain_normalized_totals(spark: SparkSession, base: str) -> DataFrame:
    """A fan-out made right: the child is pre-aggregated by the parent's key before the join."""
    plan = _service(spark, base).plan(LEFT_TOTALS)
    assert isinstance(plan, QueryPlan) and "PRE_AGGREGATED" in plan.changes, plan
    return plan.df


def value_respelled(spark: SparkSession, base: str) -> DataFrame:
    """A literal in another spelling finds the stored value."""
    segments = sorted(r[0] for r in read_table(spark, base, "customer").select("c_mktsegment").distinct().limit(31).collect())
    customer = STAR.table("customer")
    cols = tuple(Column(c.name, c.type, c.description, c.sensitivity, c.queryable, c.primary_key, tuple(segments), True) if c.name == "c_mktsegment" else c for c in customer.columns)
    catalog = Catalog(tuple(Table(t.name, cols, t.description, t.aliases, t.queryable, t.relationships) if t is customer else t for t in STAR.tables))
    plan = _service(spark, base, catalog).plan("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'buil-ding'")
    assert isinstance(plan, QueryPlan), plan
    return plan.df


def value_probe_spellings(spark: SparkSession, base: str) -> DataFrame:
    """Stored spellings of a value that isn't stored as written."""
    return spellings(read_table(spark, base, "orders").select("o_orderpriority"), "o_orderpriority", "1 urgent")


def report_filtered(spark: SparkSession, base: str) -> DataFrame:
    """A saved query with a report's filter on one table."""
    register_tables(spark, base, TABLES)
    sql, n, skipped = rewrite.filter_table(spark, STAR, REPORT, "orders", "o_orderstatus", ["F", "P"])
    assert (n, skipped) == (1, 0)
    return _service(spark, base).plan(sql).df


def report_filtered_day(spark: SparkSession, base: str) -> DataFrame:
    """A saved query narrowed to one day."""
    register_tables(spark, base, TABLES)
    sql, _, _ = rewrite.filter_table(spark, STAR, "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus", "orders", "o_orderdate", day="1998-03-02")
    return _service(spark, base).plan(sql).df


def condition_edited(spark: SparkSession, base: str) -> DataFrame:
    """A query with one literal replaced and one condition dropped."""
    register_tables(spark, base, TABLES)
    sql = "SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 GROUP BY o_orderpriority"
    return _service(spark, base).plan(rewrite.edit_conditions(spark, sql, {0: ["O"]}, {1})).df


def nulls_placed_last(spark: SparkSession, base: str) -> DataFrame:
    """An ascending top list that doesn't start with nulls."""
    plan = _service(spark, base).plan("SELECT c_custkey, NULLIF(c_mktsegment, 'BUILDING') AS segment FROM customer ORDER BY NULLIF(c_mktsegment, 'BUILDING'), c_custkey LIMIT 12")
    assert "NULLS_LAST" in plan.changes
    return plan.df


def explanations(spark: SparkSession, base: str) -> DataFrame:
    """What the explainer reads out of one query."""
    e = rewrite.explain(spark, STAR, "SELECT c.c_mktsegment, SUM(o.o_totalprice) FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'F' AND o.o_totalprice BETWEEN 1 AND 9 GROUP BY c.c_mktsegment ORDER BY c.c_mktsegment DESC LIMIT 5")
    return spark.createDataFrame([(k, "; ".join(v) if isinstance(v, list) else str(v)) for k, v in e.items()], "what string, said string")


def surface_admitted(spark: SparkSession, base: str) -> DataFrame:
    """All queries of the relational surface pass the gates, but for those that read a hidden column."""
    g = _service(spark, base)
    rows = [(n, "PLANNED" if isinstance(p := g.plan(s), QueryPlan) else p.code) for n, (s, _) in SQL_PAIRS.items()]
    return _verdicts(spark, rows).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def ties_flagged(spark: SparkSession, base: str) -> DataFrame:
    """Queries that ask for the one row at an extreme, and whether several share it."""
    register_tables(spark, base, TABLES)
    some = [
        ("largest size", "SELECT p_partkey FROM part WHERE p_size = (SELECT MAX(p_size) FROM part)"),
        ("first rank", "SELECT k FROM (SELECT n_regionkey AS k, rank() OVER (ORDER BY n DESC) AS r FROM (SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey)) x WHERE r = 1"),
        ("no extreme", "SELECT p_partkey FROM part WHERE p_size = 50"),
    ]
    rows = [(n, rewrite.ties_possible(spark.sql(q)), spark.sql(q).limit(2).count() > 1) for n, q in some]
    return spark.createDataFrame(rows, "name string, extreme boolean, several boolean")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (gate_verdicts, grain_verdicts, authority_verdicts, cost_verdicts, grain_normalized_totals, value_respelled, value_probe_spellings, report_filtered, report_filtered_day, condition_edited, nulls_placed_last, explanations, surface_admitted, ties_flagged)
}

_HIDDEN = 1  # one relational query reads supplier.s_acctbal
SQL = {
    "gate_verdicts": _values([(n, v) for n, _, v in GATE_CASES], "name, verdict"),
    "grain_verdicts": _values([(n, v) for n, _, v in GRAIN_CASES], "name, verdict"),
    "authority_verdicts": _values([(n, v) for n, _, _, _, v in AUTHORITY_CASES], "name, verdict"),
    "cost_verdicts": _values([("scan", "PLANNED"), ("self theta", "QUERY_TOO_EXPENSIVE")], "name, verdict"),
    "grain_normalized_totals": "SELECT o_orderstatus AS status, ROUND(SUM(o_totalprice), 2) AS total, ROUND(SUM(q), 2) AS qty FROM orders LEFT JOIN (SELECT l_orderkey, SUM(l_quantity) AS q FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o_orderkey GROUP BY o_orderstatus",
    "value_respelled": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'",
    "value_probe_spellings": "SELECT DISTINCT o_orderpriority AS value FROM orders WHERE regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '', 'g') = '1urgent'",
    "report_filtered": REPORT.replace("FROM orders o", "FROM (SELECT * FROM orders WHERE o_orderstatus IN ('F', 'P')) o"),
    "report_filtered_day": "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-03-02' AND o_orderdate < TIMESTAMP '1998-03-03' GROUP BY o_orderstatus",
    "condition_edited": "SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY o_orderpriority",
    "nulls_placed_last": "SELECT c_custkey, NULLIF(c_mktsegment, 'BUILDING') AS segment FROM customer ORDER BY 2 NULLS LAST, c_custkey LIMIT 12",
    "explanations": _values(
        [("tables", "customer; orders"), ("measures", "SUM(o.o_totalprice)"), ("conditions", "o.o_orderstatus = 'F'; o.o_totalprice BETWEEN 1, 9"), ("groups", "c.c_mktsegment"), ("orderings", "c.c_mktsegment DESC"), ("limit", "5"), ("distinct", "False")],
        "what, said",
    ),
    "surface_admitted": f"SELECT 'PLANNED' AS verdict, CAST({len(SQL_PAIRS) - _HIDDEN} AS BIGINT) AS n UNION ALL SELECT 'FORBIDDEN_COLUMN', {_HIDDEN}",
    "ties_flagged": """SELECT 'largest size' AS name, TRUE AS extreme, (SELECT COUNT(*) > 1 FROM part WHERE p_size = (SELECT MAX(p_size) FROM part)) AS several
UNION ALL SELECT 'first rank', TRUE, (SELECT COUNT(*) > 1 FROM (SELECT rank() OVER (ORDER BY COUNT(*) DESC) AS r FROM nation GROUP BY n_regionkey) x WHERE r = 1)
UNION ALL SELECT 'no extreme', FALSE, (SELECT COUNT(*) > 1 FROM part WHERE p_size = 50)""",
}
