"""Running questions, reports and sources on the data: what comes out is compared to SQL on the same tables."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.catalog import STAR, Catalog
from quernel.operators import report, results
from quernel.plans import context, policy
from quernel.plans.decide import Budget, Decision, Scripted, answer, replay
from quernel.plans.execute import ExecutionError, run_bounded
from quernel.plans.refresh import rows_of
from quernel.plans.reports import Reports
from quernel.plans.service import GovernedSql, QueryPlan
from quernel.queries.relational import SQL_PAIRS, TABLES
from quernel.sources import ParquetSource, read_table, register_tables
from quernel.sources.audit import append_events, append_run, read_runs
from quernel.sources.database import COLUMNS, KEYS, LINKS, DatabaseSource
from quernel.workspace import shared_dir


def _service(spark: SparkSession, base: str, catalog: Catalog = STAR) -> GovernedSql:
    register_tables(spark, base, TABLES)
    return GovernedSql(spark, catalog, timeout_s=300, max_plan_rows=1e12, max_plan_cost=1e12)


def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: The catalog with nothing hidden.
OPEN = Catalog(tuple(replace(t, columns=tuple(replace(c, queryable=True) for c in t.columns)) for t in STAR.tables))


# -- bounded results and their checks -------------------------------------------

BOUNDED = {
    "lines": "SELECT l_orderkey, l_partkey FROM lineitem",
    "statuses": "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus",
    "no such status": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'X'",
    "none counted": "SELECT COUNT(*) AS n, SUM(o_totalprice) AS total FROM orders WHERE o_orderstatus = 'X'",
    "segments": "SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment ORDER BY n DESC, c_mktsegment",
    "brands by name": "SELECT p_brand, COUNT(*) AS n FROM part GROUP BY p_brand ORDER BY p_brand",
}


def bounded_results(spark: SparkSession, base: str) -> DataFrame:
    """Rows fetched, whether there are more, whether the answer looks empty, and how often a falling measure rises."""
    g = _service(spark, base)
    rows = []
    for n, q in BOUNDED.items():
        r = g.execute(g.plan(q))
        rising = results.out_of_order(r.rows, "n") if "ORDER BY" in q else None
        rows.append((n, r.row_count, r.truncated, results.looks_empty(r.rows), rising))
    return spark.createDataFrame(rows, "name string, n_rows int, truncated boolean, looks_empty boolean, rises int")


def ranked_nulls_last(spark: SparkSession, base: str) -> DataFrame:
    """An ascending rank in which nulls come last, by the rewrite."""
    plan = _service(spark, base).plan("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY NULLIF(c_mktsegment, 'BUILDING'), c_custkey) AS r FROM customer")
    assert "NULLS_LAST" in plan.changes
    return plan.df


def dialect_names(spark: SparkSession, base: str) -> DataFrame:
    """Functions under the names of another dialect."""
    return _service(spark, base).plan(DIALECT).df


DIALECT = "SELECT n_name, strpos(n_name, 'N') AS at, starts_with(n_name, 'N') AS starts, statement_timestamp() = transaction_timestamp() AS same_statement, CURRENT_TIME() = LOCALTIME AS same_time, LOCALTIMESTAMP = LOCALTIMESTAMP AS same_local FROM nation"


def normalized_sums(spark: SparkSession, base: str) -> DataFrame:
    """Two children of one parent, each with sums of its own, made right."""
    plan = _service(spark, base, OPEN).plan(TWO_CHILDREN)
    assert isinstance(plan, QueryPlan) and "PRE_AGGREGATED" in plan.changes, plan
    return plan.df


TWO_CHILDREN = "SELECT n.n_name AS nation, ROUND(SUM(c.c_acctbal), 2) AS customers, ROUND(SUM(s.s_acctbal), 2) AS suppliers FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name"
ORDER_TOTALS = "SELECT o.o_orderpriority AS priority, ROUND(SUM(o.o_totalprice), 2) AS total, ROUND(SUM(l.l_quantity), 2) AS qty, ROUND(SUM(l.l_extendedprice), 2) AS price FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderpriority"


def normalized_two_sums(spark: SparkSession, base: str) -> DataFrame:
    """Two sums of one child beside the parent's own."""
    plan = _service(spark, base).plan(ORDER_TOTALS)
    assert isinstance(plan, QueryPlan) and "PRE_AGGREGATED" in plan.changes, plan
    return plan.df


def arranged_rows(spark: SparkSession, base: str) -> DataFrame:
    """The first brands by natural label order, with their place."""
    brands = read_table(spark, base, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return report.arranged(brands, "p_brand", "n", "value_desc", 12).select("p_brand", "n")


def charts_suggested(spark: SparkSession, base: str) -> DataFrame:
    """The chart that each table's columns suggest."""
    rows = [(t, report.suggested_chart(read_table(spark, base, t))) for t in TABLES]
    return spark.createDataFrame(rows, "name string, chart string")


# -- introspection ----------------------------------------------------------------


def source_columns(spark: SparkSession, base: str) -> DataFrame:
    """Columns of the tables, from the files' footers."""
    some = [(t, c, k) for t, c, k, _ in ParquetSource(base).introspect(spark) if t in TABLES]
    return spark.createDataFrame(some, "name string, field string, kind string")


def _database(spark: SparkSession, base: str) -> DatabaseSource:
    """The star schema behind the interface of a database: its catalogs from the files and the declared keys."""
    kinds = {"int": "integer", "string": "text", "double": "double precision"}
    columns = [(t, c, kinds.get(k, k), "YES", i) for i, (t, c, k, _) in enumerate(ParquetSource(base).introspect(spark)) if t in TABLES]
    keys = [(t.name, c, f"{t.name}_pk", "PRIMARY KEY") for t in STAR.tables for c in sorted(t.key)]
    links = [(t.name, r.column, r.target, r.target_column) for t in STAR.tables for r in t.relationships]
    frames = {COLUMNS: (columns, "t string, c string, k string, n string, p int"), KEYS: (keys, "t string, c string, n string, k string"), LINKS: (links, "t string, c string, r string, rc string")}

    def read(sql: str) -> DataFrame:
        for text, (rows, schema) in frames.items():
            if sql == text.format(schema="public", where=""):
                return spark.createDataFrame(rows, schema)
        some, _, name = sql.removeprefix("SELECT ").partition(" FROM public.")
        return read_table(spark, base, name).select(*some.split(", "))

    return DatabaseSource("postgresql", {"host": "h", "database": "d", "user": "u"}, read)


def database_statistics(spark: SparkSession, base: str) -> DataFrame:
    """Shares and domains of an order's columns, read as from a database."""
    stats = _database(spark, base).column_stats("orders", ["o_orderstatus", "o_orderpriority", "o_custkey"])
    return stats.select("column", "n", "null_share", "complete", F.coalesce("values", F.lit("")).alias("values"))


def database_links(spark: SparkSession, base: str) -> DataFrame:
    """Declared links of a database's catalog with their match rate, and whether the target repeats."""
    db = _database(spark, base)
    rows = [(t.name, r.column, r.target, db.match_rate(t.name, r.column, r.target, r.target_column), db.has_duplicates(r.target, r.target_column)) for t in db.catalog().tables for r in t.relationships]
    return spark.createDataFrame(rows, "name string, field string, target string, rate double, repeats boolean")


def inferred_measures(spark: SparkSession, base: str) -> DataFrame:
    """The columns that add up, inferred from types, keys and links."""
    return spark.createDataFrame([(t, c, k) for (t, c), k in STAR.measures().items()], "name string, field string, behaviour string")


def plan_inputs(spark: SparkSession, base: str) -> DataFrame:
    """The tables that each query of the relational surface reads, by its plan."""
    g = _service(spark, base)
    rows = [(n, t) for n, (q, _) in SQL_PAIRS.items() for t in policy.check(g.spark, OPEN, q).tables]
    return spark.createDataFrame(rows, "query string, name string")


# -- context --------------------------------------------------------------------------

QUESTIONS = ["order totals by market segment", "which suppliers sell the parts of a region", "quantities of lines by nation", "events per user and type"]


def retrieval_scores(spark: SparkSession, base: str) -> DataFrame:
    """How well each table answers to each question's words."""
    rows = [(q, t.name, context.score(t, context.words(q))) for q in QUESTIONS for t in STAR.tables]
    return spark.createDataFrame(rows, "question string, name string, score int")


def join_paths(spark: SparkSession, base: str) -> DataFrame:
    """The number of links between each two tables that are close."""
    links = context.neighbours(STAR)
    rows = [(a, b, len(p) - 1) for a in sorted(links) for b in sorted(links) if (p := context.shortest_path(links, a, b))]
    return spark.createDataFrame(rows, "source string, target string, links int")


# -- questions, their audit, probes ----------------------------------------------------

STATUSES = "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus"
BIG = "SELECT COUNT(*) AS n FROM orders WHERE o_totalprice > 300000"
OK = Decision("ANSWER", STATUSES, ("orders",))
ASK = Decision("NEEDS_CLARIFICATION", question="which?")
#: name: decisions in order, how answer() is called.
SCENARIOS: dict[str, tuple[list[Decision], dict]] = {
    "answer": ([OK], {}),
    "repaired": ([Decision("ANSWER", "SELECT nothing FROM orders", ("orders",)), OK], {}),
    "repaired once only": ([Decision("ANSWER", "SELECT nothing FROM orders", ("orders",))], {}),
    "beyond the request": ([Decision("ANSWER", "SELECT c_name FROM customer", ("customer",))], {"allowed": {"orders"}}),
    "probe, then answer": ([Decision("EXPLORE", probes=("SELECT COUNT(*) AS n FROM orders",)), OK], {}),
    "probes without end": ([Decision("EXPLORE", probes=("SELECT COUNT(*) AS n FROM orders",))], {}),
    "looks first": ([ASK, OK], {}),
    "still asks": ([ASK], {}),
    "readings agree": ([Decision("NEEDS_CLARIFICATION", question="which?", readings=(STATUSES, STATUSES.replace("COUNT(*)", "COUNT(o_orderkey)")))], {}),
    "readings differ": ([Decision("NEEDS_CLARIFICATION", question="which?", readings=(STATUSES, BIG))], {}),
    "first reading assumed": ([Decision("NEEDS_CLARIFICATION", question="which?", readings=(BIG, STATUSES))], {"mode": "assume"}),
    "respelled": ([Decision("ANSWER", "SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_orderpriority = '1 urgent' GROUP BY o_orderpriority", ("orders",))], {}),
    "blocked": ([Decision("BLOCKED_POLICY")], {}),
    "no statement": ([Decision("ANSWER")], {}),
    "tokens spent": ([replace(ASK, tokens=200_000), OK], {}),
}


def decision_runs(spark: SparkSession, base: str) -> DataFrame:
    """How scripted runs end, with the rows of their answers."""
    g = _service(spark, base)
    rows = []
    for name, (script, options) in SCENARIOS.items():
        a = answer(g, Scripted(list(script)), name, Budget(), **options)
        rows.append((name, a.outcome, a.reason, a.result.row_count if a.result else None, int(sum(r["n"] for r in a.result.rows)) if a.result and a.outcome == "EXECUTED" else None))
    return spark.createDataFrame(rows, "name string, outcome string, reason string, n_rows int, counted long")


def audited_runs(spark: SparkSession, base: str) -> DataFrame:
    """The audit log of some runs, read back."""
    g, path = _service(spark, base), _folder(spark, "audit")
    for name in ("answer", "beyond the request", "still asks"):
        script, options = SCENARIOS[name]
        answer(g, Scripted(list(script)), name, log=partial(append_run, spark, path), about={"actor": "ann"}, **options)
    return read_runs(spark, path).select("question", "actor", "model_decision", "runtime_outcome", "runtime_reason", "row_count", "truncated", F.get_json_object("trace", "$.status").alias("status"))


def replayed(spark: SparkSession, base: str) -> DataFrame:
    """A saved statement run again without a proposer."""
    return rows_of(spark, replay(_service(spark, base), STATUSES, {"orders"}))


def probe_reports(spark: SparkSession, base: str) -> DataFrame:
    """What a proposer is told of its probes: counts of all, rows only of shared columns."""
    g = _service(spark, base)
    probes = {"shared": "SELECT r_name FROM region ORDER BY r_name", "not shared": "SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment", "hidden": "SELECT s_acctbal FROM supplier", "beyond": "SELECT o_orderkey FROM orders"}
    rows = []
    for name, q in probes.items():
        s = Scripted([Decision("EXPLORE", probes=(q,)), Decision("BLOCKED_POLICY")])
        answer(g, s, name, allowed={"region", "customer", "supplier"}, shared=frozenset({("region", "r_name")}))
        rows.append((name, s.seen[1][0]))
    return spark.createDataFrame(rows, "name string, said string")


def provenance_chain(spark: SparkSession, base: str) -> DataFrame:
    """Events of regions, each hashed with the one before, read back from the sink."""
    path = _folder(spark, "events")
    names = [r[0] for r in read_table(spark, base, "region").select("r_name").orderBy("r_name").collect()]
    append_events(spark, path, [{"region": n, "step": i} for i, n in enumerate(names)])
    return spark.read.schema("body string, hash string").json(path)


def run_guards(spark: SparkSession, base: str) -> DataFrame:
    """Errors of running queries by class, a run beyond its time, and a plan that wasn't issued."""
    import copy

    g = _service(spark, base)
    cases = {
        "division": "SELECT 1 / (r_regionkey - r_regionkey) AS x FROM region", "text": "SELECT CAST(r_name AS INT) AS x FROM region", "overflow": "SELECT 2147483647 + r_regionkey AS x FROM region",
        "several rows": "SELECT (SELECT r_regionkey FROM region) AS x", "fine": "SELECT r_regionkey FROM region",
    }
    rows = []
    for name, q in cases.items():
        try:
            run_bounded(spark, spark.sql(q), timeout_s=300)
            rows.append((name, "RAN"))
        except ExecutionError as e:
            rows.append((name, e.kind))
    plan = g.plan(STATUSES)
    for name, p in (("copied plan", copy.copy(plan)), ("issued plan", plan)):
        try:
            g.execute(p)
            rows.append((name, "RAN"))
        except ExecutionError as e:
            rows.append((name, e.kind))
    slow = spark.range(10**6).crossJoin(spark.range(10**6).toDF("b")).where("id * b = 7")
    try:
        run_bounded(spark, slow.groupBy().count(), timeout_s=0.5)
    except ExecutionError as e:
        rows.append(("too slow", e.kind))
    return spark.createDataFrame(rows, "name string, verdict string")


def report_snapshot(spark: SparkSession, base: str) -> DataFrame:
    """The rows of a scheduled report's card under its filter, from the snapshot that the one claim made."""
    now = dt.datetime(2026, 1, 5, 8)
    reports = Reports(spark, _folder(spark, "reports"), _service(spark, base))
    r = reports.create("ann", "governed", "Orders", now)
    r = reports.update(r.id, "ann", 1, now, cards={"c1": {"sql": "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority"}}, filters=({"table": "orders", "column": "o_orderstatus", "values": ["F", "O"]},))
    reports.schedule(r.id, "ann", now, "daily")
    later = now + dt.timedelta(days=1)
    assert len(reports.run_due(later)) == 1 and not reports.run_due(later)
    rows = F.explode(F.from_json(F.get_json_object("cards", "$.c1.rows"), "array<struct<o_orderpriority string, n bigint>>"))
    return reports.snapshot_table().select(rows.alias("r"), "scheduled").select("r.*", "scheduled")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        bounded_results, ranked_nulls_last, dialect_names, normalized_sums, normalized_two_sums, arranged_rows, charts_suggested, source_columns, database_statistics, database_links, inferred_measures,
        plan_inputs, retrieval_scores, join_paths, decision_runs, audited_runs, replayed, probe_reports, provenance_chain, run_guards, report_snapshot,
    )
}


def _text(v: object) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


def _rows(rows: list[tuple], names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_text, r)) + ')' for r in rows)}) AS t({names})"


_KINDS = "CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END"
_OF_TABLES = "table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + ")"
_LINKS = [(t.name, r.column, r.target, r.target_column) for t in STAR.tables for r in t.relationships]


def _words(text: str) -> str:
    """DuckDB: the words of a text, of three letters at least, with their plain singulars and plurals, as a list."""
    found = f"regexp_extract_all(lower({text}), '[a-z0-9]{{3,}}')"
    forms = "list_concat([w], CASE WHEN w LIKE '%ies' AND len(w) > 4 THEN [w[:-4] || 'y'] ELSE [] END, CASE WHEN w LIKE '%es' AND len(w) > 4 THEN [w[:-3]] ELSE [] END, [CASE WHEN w LIKE '%s' AND len(w) > 3 THEN w[:-2] ELSE w || 's' END])"
    return f"list_distinct(flatten(list_transform({found}, lambda w: {forms})))"


_EMPTY = "SELECT {!r} AS name, CAST(least(COUNT(*), 1000) AS INTEGER) AS n_rows, COUNT(*) > 1000 AS truncated, {} AS looks_empty, {} AS rises FROM ({}) q"
_RISES = "(SELECT CAST(COUNT(*) AS INTEGER) FROM (SELECT n, lag(n) OVER (ORDER BY {}) AS b FROM ({}) y) x WHERE n > b)"
SQL = {
    "bounded_results": " UNION ALL ".join(
        _EMPTY.format(n, "TRUE" if n == "none counted" else "COUNT(*) = 0", _RISES.format({"segments": "n DESC, c_mktsegment", "brands by name": "p_brand"}[n], q) if "ORDER BY" in q else "NULL", q) for n, q in BOUNDED.items()
    ),
    "ranked_nulls_last": "SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY NULLIF(c_mktsegment, 'BUILDING') NULLS LAST, c_custkey) AS INTEGER) AS r FROM customer",
    "dialect_names": "SELECT n_name, CAST(strpos(n_name, 'N') AS INTEGER) AS at, starts_with(n_name, 'N') AS starts, TRUE AS same_statement, TRUE AS same_time, TRUE AS same_local FROM nation",
    "normalized_sums": "SELECT n_name AS nation, ROUND((SELECT SUM(c_acctbal) FROM customer WHERE c_nationkey = n_nationkey), 2) AS customers, ROUND((SELECT SUM(s_acctbal) FROM supplier WHERE s_nationkey = n_nationkey), 2) AS suppliers FROM nation",
    "normalized_two_sums": "SELECT o_orderpriority AS priority, ROUND(SUM(o_totalprice), 2) AS total, ROUND(SUM(q), 2) AS qty, ROUND(SUM(p), 2) AS price FROM orders LEFT JOIN (SELECT l_orderkey, SUM(l_quantity) AS q, SUM(l_extendedprice) AS p FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey GROUP BY 1",
    "arranged_rows": "SELECT p_brand, COUNT(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, TRY_CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) LIMIT 12",
    "charts_suggested": f"""SELECT table_name AS name, CASE WHEN bool_or(data_type LIKE 'TIMESTAMP%') AND bool_or(m) THEN 'line' WHEN bool_or(data_type = 'VARCHAR') AND bool_or(m) THEN 'bar' ELSE 'table' END AS chart
FROM (SELECT *, data_type IN ('INTEGER', 'BIGINT', 'DOUBLE') AND NOT lower(column_name) LIKE '%\\_id' ESCAPE '\\' AS m FROM duckdb_columns() WHERE {_OF_TABLES}) c GROUP BY table_name""",
    "source_columns": f"SELECT table_name AS name, column_name AS field, {_KINDS} AS kind FROM duckdb_columns() WHERE {_OF_TABLES}",
    "database_statistics": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", COUNT(*) AS n, 0.0 AS null_share, COUNT(DISTINCT {c}) <= 30 AS complete, CASE WHEN COUNT(DISTINCT {c}) <= 30 THEN string_agg(DISTINCT CAST({c} AS VARCHAR), '|' ORDER BY CAST({c} AS VARCHAR)) ELSE '' END AS values FROM orders"
        for c in ("o_orderstatus", "o_orderpriority", "o_custkey")
    ),
    "database_links": " UNION ALL ".join(
        f"SELECT '{t}' AS name, '{c}' AS field, '{x}' AS target, (SELECT round(COUNT(*) FILTER (WHERE {c} IN (SELECT {y} FROM {x})) / COUNT(*), 4) FROM {t}) AS rate, (SELECT COUNT(*) > COUNT(DISTINCT {y}) FROM {x}) AS repeats" for t, c, x, y in _LINKS
    ),
    "inferred_measures": f"SELECT table_name AS name, column_name AS field, 'ADDITIVE' AS behaviour FROM duckdb_columns() WHERE {_OF_TABLES} AND data_type IN ('INTEGER', 'BIGINT', 'DOUBLE') AND column_name NOT LIKE '%key' AND column_name NOT IN ('l_linenumber', 'event_id')",
    "plan_inputs": _rows([(n, t) for n, (q, _) in SQL_PAIRS.items() for t in TABLES if re.search(rf"(?:FROM|JOIN|,)\s+{t}\b", q)], "query, name"),
    "retrieval_scores": f"""WITH q AS (SELECT unnest([{', '.join(map(_text, QUESTIONS))}]) AS question), t AS ({_rows([(t.name, t.description, ' '.join(c.name for c in t.columns)) for t in STAR.tables], 'name, description, fields')}),
k AS (SELECT question, name, {_words('question')} AS asked, {_words('name')} AS n, {_words('description')} AS d, {_words("replace(fields, '_', ' ')")} AS f FROM q, t)
SELECT question, name, CAST(10 * len(list_intersect(asked, n)) + 3 * len(list_intersect(asked, d)) + len(list_intersect(asked, f)) AS INTEGER) AS score FROM k""",
    "join_paths": f"""WITH RECURSIVE e AS (SELECT a, b FROM ({_rows(sorted({(t, x) for t, _, x, _ in _LINKS} | {(x, t) for t, _, x, _ in _LINKS}), 'a, b')}) l), names AS ({_rows([(t.name,) for t in STAR.tables], 'n')}),
w(source, target, links) AS (SELECT n, n, 0 FROM names UNION ALL SELECT source, b, links + 1 FROM w JOIN e ON e.a = w.target WHERE links < 2)
SELECT source, target, CAST(MIN(links) AS INTEGER) AS links FROM w GROUP BY 1, 2""",
    "audited_runs": """SELECT 'answer' AS question, 'ann' AS actor, 'ANSWER' AS model_decision, 'EXECUTED' AS runtime_outcome, NULL AS runtime_reason, (SELECT CAST(COUNT(DISTINCT o_orderstatus) AS INTEGER) FROM orders) AS row_count, FALSE AS truncated, 'EXECUTED' AS status
UNION ALL SELECT 'beyond the request', 'ann', 'ANSWER', 'REJECTED', 'UNAUTHORIZED_RELATION', NULL, FALSE, 'REJECTED' UNION ALL SELECT 'still asks', 'ann', 'NEEDS_CLARIFICATION', 'NEEDS_CLARIFICATION', NULL, NULL, FALSE, 'NEEDS_CLARIFICATION'""",
    "replayed": STATUSES,
    "probe_reports": """SELECT 'shared' AS name, 'PROBE ' || COUNT(*) || ' rows; r_name ' || COUNT(DISTINCT r_name) || ' distinct 0 null' || string_agg(chr(10) || r_name, '' ORDER BY r_name) AS said FROM region
UNION ALL SELECT 'not shared', 'PROBE ' || COUNT(*) || ' rows; c_mktsegment ' || COUNT(*) || ' distinct 0 null, n ' || COUNT(DISTINCT n) || ' distinct 0 null' FROM (SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY 1) x
UNION ALL SELECT 'hidden', 'PROBE FORBIDDEN_COLUMN' UNION ALL SELECT 'beyond', 'PROBE UNAUTHORIZED_RELATION'""",
    "provenance_chain": """WITH RECURSIVE e AS (SELECT row_number() OVER (ORDER BY r_name) - 1 AS i, r_name FROM region), b AS (SELECT i, '{"region":"' || r_name || '","step":' || i || '}' AS body FROM e),
c(i, body, hash) AS (SELECT i, body, sha256(body) FROM b WHERE i = 0 UNION ALL SELECT b.i, b.body, sha256(c.hash || b.body) FROM c JOIN b ON b.i = c.i + 1) SELECT body, hash FROM c""",
    "run_guards": _rows([("division", "DIVISION_BY_ZERO"), ("text", "INVALID_TEXT_CONVERSION"), ("overflow", "NUMERIC_OVERFLOW"), ("several rows", "MULTIPLE_SUBQUERY_ROWS"), ("fine", "RAN"), ("copied plan", "PLAN_NOT_ISSUED"), ("issued plan", "RAN"), ("too slow", "STATEMENT_TIMEOUT")], "name, verdict"),
    "report_snapshot": "SELECT o_orderpriority, COUNT(*) AS n, TRUE AS scheduled FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_orderpriority",
}

_RAN = "SELECT '{}' AS name, 'EXECUTED' AS outcome, NULL AS reason, CAST(COUNT(*) AS INTEGER) AS n_rows, CAST(SUM(n) AS BIGINT) AS counted FROM ({}) q"
_ENDED = "SELECT '{}', '{}', {}, NULL, NULL"
SQL["decision_runs"] = " UNION ALL ".join(
    [_RAN.format(n, STATUSES) for n in ("answer", "repaired", "probe, then answer", "looks first", "readings agree")]
    + [_RAN.format("first reading assumed", BIG), _RAN.format("respelled", "SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1")]
    + [
        _ENDED.format(n, o, _text(r))
        for n, o, r in (
            ("repaired once only", "REJECTED", "UNKNOWN_COLUMN"), ("beyond the request", "REJECTED", "UNAUTHORIZED_RELATION"), ("probes without end", "BUDGET_EXHAUSTED", "BUDGET_CALLS"), ("still asks", "NEEDS_CLARIFICATION", None),
            ("readings differ", "NEEDS_CLARIFICATION", None), ("blocked", "BLOCKED_POLICY", None), ("no statement", "INVALID_PROPOSAL", "ANSWER_WITHOUT_SQL_OR_RELATIONS"), ("tokens spent", "NEEDS_CLARIFICATION", None),
        )
    ]
)
