"""Queries of the profiling, relationship, result and report operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.catalog import STAR
from quernel.operators import profile, relate, report, results
from quernel.queries.relational import TABLES, run_sql
from quernel.sources import read_table, register_tables

RUN_COLUMNS = ["actor", "connection_id", "question_lang", "preset_id", "proposal_source", "model_decision", "model_reason_code", "runtime_outcome", "runtime_reason", "provider", "model"]
#: Tables and their keys.
ELIGIBLE_IN = {"customer": {"c_custkey"}, "orders": {"o_orderkey"}, "part": {"p_partkey"}, "nation": {"n_nationkey"}, "region": {"r_regionkey"}, "connections": {"id"}, "audit_runs": {"run_id"}, "reports": {"id"}}
STACK = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value FROM audit_runs" for c in RUN_COLUMNS)


def _runs(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "audit_runs").select(*RUN_COLUMNS)


def profile_null_blank(spark: SparkSession, base: str) -> DataFrame:
    return profile.shares(_runs(spark, base), RUN_COLUMNS)


def profile_value_counts(spark: SparkSession, base: str) -> DataFrame:
    return profile.value_counts(_runs(spark, base), ["runtime_outcome", "model", "question_lang", "provider"])


def profile_domains(spark: SparkSession, base: str) -> DataFrame:
    return profile.domains(_runs(spark, base), RUN_COLUMNS)


def value_patterns(spark: SparkSession, base: str) -> DataFrame:
    return profile.patterns(_runs(spark, base), ["actor", "model"])


def profile_separators(spark: SparkSession, base: str) -> DataFrame:
    return profile.separators(read_table(spark, base, "audit_runs").select("result_columns", "model", "question"), ["result_columns", "model", "question"])


def eligible_columns(spark: SparkSession, base: str) -> DataFrame:
    some = [(t, c) for t, k in ELIGIBLE_IN.items() for c in profile.eligible(read_table(spark, base, t), k)]
    return spark.createDataFrame(some, "table string, column string")


def format_examples(spark: SparkSession, base: str) -> DataFrame:
    dates = read_table(spark, base, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("code"), "o_orderpriority")
    return profile.format_examples(dates, ["day", "code", "o_orderpriority"])


def unique_keys(spark: SparkSession, base: str) -> DataFrame:
    out = None
    for t in ("region", "nation", "customer", "orders"):
        one = profile.unique_columns(read_table(spark, base, t)).withColumn("table", F.lit(t))
        out = one if out is None else out.unionByName(one)
    return out.where("is_unique").select("table", "column")


def duplicate_keys(spark: SparkSession, base: str) -> DataFrame:
    some = [("customer", "c_custkey"), ("lineitem", "l_orderkey"), ("customers", "id"), ("reports", "id")]
    return spark.createDataFrame([(t, c, profile.has_duplicates(read_table(spark, base, t).select(c), c)) for t, c in some], "table string, column string, duplicates boolean")


def match_rates(spark: SparkSession, base: str) -> DataFrame:
    some = [("orders", "o_custkey", "customer", "c_custkey"), ("events", "user_id", "customer", "c_custkey"), ("lineitem", "l_partkey", "supplier", "s_suppkey"), ("report_snapshots", "report_id", "reports", "id")]
    out = None
    for s, a, t, b in some:
        one = profile.match_rate(read_table(spark, base, s).select(a), a, read_table(spark, base, t).select(b), b)
        one = one.select(F.lit(f"{s}.{a}").alias("source"), F.lit(f"{t}.{b}").alias("target"), "n", "matched", "rate")
        out = one if out is None else out.unionByName(one)
    return out


def relationship_candidates(spark: SparkSession, base: str) -> DataFrame:
    register_tables(spark, base, TABLES)
    bare = STAR.without_links()
    unique = {t.name: set(t.key) for t in bare.tables if len(t.key) == 1}
    some = relate.verified(spark, relate.candidates(bare, unique))
    return spark.createDataFrame([(c.table, c.column, c.target, c.target_column, c.rate) for c in some], "table string, column string, target string, target_column string, rate double")


def percent_out_of_range(spark: SparkSession, base: str) -> DataFrame:
    df = run_sql(spark, base, "SELECT o_orderpriority, 100.0 * SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / COUNT(*) AS done_percent, CAST(100.0 * SUM(o_totalprice) / MAX(o_totalprice) AS DOUBLE) AS growth_pct FROM orders GROUP BY o_orderpriority")
    return results.percent_out_of_range(df).select("column", "n_outside")


def readings_compare(spark: SparkSession, base: str) -> DataFrame:
    a = run_sql(spark, base, "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey")
    b = run_sql(spark, base, "SELECT o_custkey, COUNT(DISTINCT o_orderkey) AS m FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey")
    return results.same_reading(a, b)


def probe_report(spark: SparkSession, base: str) -> DataFrame:
    return results.probe_report(read_table(spark, base, "audit_runs").select("actor", "model", "runtime_outcome", "row_count"))


def filter_options(spark: SparkSession, base: str) -> DataFrame:
    return report.filter_options(read_table(spark, base, "part").select("p_brand"), "p_brand")


def chart_with_rest(spark: SparkSession, base: str) -> DataFrame:
    sales = run_sql(spark, base, "SELECT o.o_orderpriority AS priority, n.n_name AS nation, o.o_totalprice AS price FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey")
    return report.with_rest(sales, "priority", "nation", "price").select("category", "series", F.round("total", 2).alias("total"))


def chart_pivot(spark: SparkSession, base: str) -> DataFrame:
    rows = run_sql(spark, base, "SELECT l_linestatus, l_returnflag, l_quantity FROM lineitem")
    wide = report.pivot(rows, "l_linestatus", "l_returnflag", "l_quantity")
    return wide.select("category", *(F.round(c, 2).alias(f"flag_{c}") for c in wide.columns if c != "category"))


def pie_top_rest(spark: SparkSession, base: str) -> DataFrame:
    rows = run_sql(spark, base, "SELECT n.n_name AS nation, c.c_acctbal AS bal FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey")
    return report.slices(rows, "nation", "bal").select("label", F.round("total", 2).alias("total"))


def scatter_points(spark: SparkSession, base: str) -> DataFrame:
    return report.points(read_table(spark, base, "customer").select("c_custkey", "c_acctbal"), "c_custkey", "c_acctbal")


def number_compare(spark: SparkSession, base: str) -> DataFrame:
    years = run_sql(spark, base, "SELECT YEAR(o_orderdate) AS y, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY YEAR(o_orderdate)")
    out = report.compared(years, "y", "total")
    return out.select(*(F.round(c, 4).alias(c) for c in out.columns))


def labels_collapse(spark: SparkSession, base: str) -> DataFrame:
    return report.labels_collapse(read_table(spark, base, "orders"), "o_orderpriority")


def csv_guard(spark: SparkSession, base: str) -> DataFrame:
    runs = read_table(spark, base, "audit_runs").select("question").distinct()
    return runs.select(report.csv_safe(F.col("question")).alias("cell"))


def snapshot_retention(spark: SparkSession, base: str) -> DataFrame:
    snaps = read_table(spark, base, "report_snapshots").select("id", "report_id", "taken_at")
    return report.latest_snapshots(snaps, "report_id", "taken_at", "id", 3).select("id", "report_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        profile_null_blank, profile_value_counts, profile_domains, value_patterns, profile_separators, eligible_columns, format_examples, unique_keys, duplicate_keys, match_rates,
        relationship_candidates, percent_out_of_range, readings_compare, probe_report, filter_options, chart_with_rest, chart_pivot, pie_top_rest, scatter_points,
        number_compare, labels_collapse, csv_guard, snapshot_retention,
    )
}


def _rates(s: str, a: str, t: str, b: str) -> str:
    return f"SELECT '{s}.{a}' AS source, '{t}.{b}' AS target, COUNT(*) AS n, COUNT(*) FILTER (WHERE {a} IN (SELECT {b} FROM {t})) AS matched, round(COUNT(*) FILTER (WHERE {a} IN (SELECT {b} FROM {t})) / COUNT(*), 4) AS rate FROM {s} WHERE {a} IS NOT NULL"


def _counted(columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value FROM audit_runs" for c in columns)


SQL = {
    "profile_null_blank": f'SELECT "column", COUNT(*) AS n, CASE WHEN avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) >= 0.01 THEN round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 2) ELSE 0.0 END AS null_share, CASE WHEN avg(CASE WHEN trim(value) = \'\' THEN 1.0 ELSE 0.0 END) >= 0.01 THEN round(avg(CASE WHEN trim(value) = \'\' THEN 1.0 ELSE 0.0 END), 2) ELSE 0.0 END AS blank_share FROM ({STACK}) s GROUP BY "column"',
    "profile_value_counts": f'SELECT "column", value, n FROM (SELECT "column", value, COUNT(*) AS n, row_number() OVER (PARTITION BY "column" ORDER BY COUNT(*) DESC, value NULLS LAST) AS rn FROM ({_counted(["runtime_outcome", "model", "question_lang", "provider"])}) s GROUP BY "column", value) x WHERE rn <= 200',
    "profile_domains": f"""WITH counted AS (SELECT "column", value, COUNT(*) AS n FROM ({STACK}) s GROUP BY 1, 2),
tot AS (SELECT "column", SUM(n) AS total, coalesce(SUM(n) FILTER (WHERE value IS NULL), 0) AS nulls FROM counted GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rn FROM counted WHERE value IS NOT NULL),
agg AS (SELECT r."column", COUNT(*) AS n_values, SUM(n) AS covered, string_agg(value, '|' ORDER BY value) AS vals FROM ranked r WHERE rn <= 31 AND length(value) <= 60 GROUP BY 1)
SELECT a."column", CAST(n_values AS BIGINT) AS n_values, n_values <= 30 AND covered + nulls >= 0.99 * total AS complete, CASE WHEN n_values <= 30 AND covered + nulls >= 0.99 * total THEN vals END AS values
FROM agg a JOIN tot t ON a."column" = t."column\"""",
    "value_patterns": f'SELECT "column", pattern, n FROM (SELECT "column", regexp_replace(value, \'[0-9]\', \'9\', \'g\') AS pattern, COUNT(*) AS n, row_number() OVER (PARTITION BY "column" ORDER BY COUNT(*) DESC, regexp_replace(value, \'[0-9]\', \'9\', \'g\')) AS rn FROM ({_counted(["actor", "model"])}) s WHERE regexp_matches(value, \'[0-9]\') GROUP BY 1, 2) x WHERE rn <= 3',
    "profile_separators": f"""SELECT "column", separator, round(avg(CASE WHEN contains(value, separator) THEN 1.0 ELSE 0.0 END), 2) AS share FROM ({_counted(["result_columns", "model", "question"])}) s, (VALUES (','), (';'), ('|')) AS p(separator)
WHERE value IS NOT NULL GROUP BY 1, 2 HAVING avg(CASE WHEN contains(value, separator) THEN 1.0 ELSE 0.0 END) >= 0.1 AND quantile_cont(length(value), 0.5) <= 60""",
    "eligible_columns": "SELECT table_name AS \"table\", column_name AS \"column\" FROM duckdb_columns() WHERE data_type = 'VARCHAR' AND table_name IN ("
    + ", ".join(f"'{t}'" for t in ELIGIBLE_IN)
    + ") AND (table_name, column_name) NOT IN ("
    + ", ".join(f"('{t}', '{c}')" for t, k in ELIGIBLE_IN.items() for c in k)
    + ") AND NOT regexp_matches(column_name, 'mail|phone|mobile|address|street|zip|postal|ssn|passport|password|secret|token|iban|birth|(first|last|full|sur)_?name')",
    "format_examples": """WITH v AS (SELECT DISTINCT 'day' AS "column", strftime(o_orderdate, '%Y-%m-%d') AS value FROM orders UNION SELECT 'code', lpad(CAST(o_custkey AS VARCHAR), 9, '0') FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY value) - 1 AS i, COUNT(*) OVER (PARTITION BY "column") AS n FROM v)
SELECT "column", string_agg(value, '|' ORDER BY value) AS examples FROM r WHERE n > 30 AND i IN (0, CAST(round((n - 1) / 2.0) AS BIGINT), n - 1) GROUP BY 1""",
    "duplicate_keys": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", COUNT({c}) > COUNT(DISTINCT {c}) AS duplicates FROM {t}" for t, c in (("customer", "c_custkey"), ("lineitem", "l_orderkey"), ("customers", "id"), ("reports", "id"))),
    "match_rates": " UNION ALL ".join(_rates(*x) for x in (("orders", "o_custkey", "customer", "c_custkey"), ("events", "user_id", "customer", "c_custkey"), ("lineitem", "l_partkey", "supplier", "s_suppkey"), ("report_snapshots", "report_id", "reports", "id"))),
    "percent_out_of_range": "SELECT 'growth_pct' AS \"column\", COUNT(DISTINCT o_orderpriority) AS n_outside FROM orders",
    "readings_compare": """WITH a AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT o_custkey, COUNT(DISTINCT o_orderkey) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey)
SELECT TRUE AS same_width, (SELECT COUNT(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_a, (SELECT COUNT(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_b""",
    "probe_report": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", COUNT(*) AS n_rows, COUNT(DISTINCT {c}) AS n_distinct, COUNT(*) - COUNT({c}) AS n_null FROM audit_runs" for c in ("actor", "model", "runtime_outcome", "row_count")),
    "filter_options": "SELECT DISTINCT p_brand AS option FROM part WHERE p_brand IS NOT NULL ORDER BY 1 LIMIT 201",
    "chart_with_rest": """WITH cells AS (SELECT o.o_orderpriority AS category, n.n_name AS series, SUM(o.o_totalprice) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY 1, 2),
ranked AS (SELECT series, row_number() OVER (ORDER BY SUM(abs(total)) DESC, series) AS rk, COUNT(*) OVER () AS n FROM cells GROUP BY series)
SELECT category, CASE WHEN rk <= 6 THEN c.series ELSE 'Other (' || (n - 6) || ')' END AS series, round(SUM(total), 2) AS total FROM cells c JOIN ranked r ON c.series = r.series GROUP BY 1, 2""",
    "chart_pivot": "SELECT l_linestatus AS category, round(SUM(l_quantity) FILTER (WHERE l_returnflag = 'A'), 2) AS flag_A, round(SUM(l_quantity) FILTER (WHERE l_returnflag = 'N'), 2) AS flag_N, round(SUM(l_quantity) FILTER (WHERE l_returnflag = 'R'), 2) AS flag_R FROM lineitem GROUP BY 1",
    "pie_top_rest": """WITH s AS (SELECT n.n_name AS label, SUM(c_acctbal) AS total FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY 1 HAVING SUM(c_acctbal) > 0), r AS (SELECT *, row_number() OVER (ORDER BY total DESC, label) AS rk FROM s)
SELECT CASE WHEN rk <= 7 THEN label ELSE 'Other' END AS label, round(SUM(total), 2) AS total FROM r GROUP BY 1""",
    "scatter_points": "SELECT c_custkey AS x, c_acctbal AS y FROM customer WHERE c_custkey IS NOT NULL AND c_acctbal IS NOT NULL ORDER BY 1, 2 LIMIT 1000",
    "number_compare": """WITH y AS (SELECT YEAR(o_orderdate) AS y, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY 1), r AS (SELECT total AS value, lead(total) OVER (ORDER BY y DESC) AS against, row_number() OVER (ORDER BY y DESC) AS rn FROM y)
SELECT round(value, 4) AS value, round(against, 4) AS against, round(value - against, 4) AS change, round((value - against) / abs(against) * 100, 4) AS change_percent FROM r WHERE rn = 1""",
    "labels_collapse": "SELECT COUNT(*) AS n_rows, COUNT(DISTINCT o_orderpriority) AS n_labels, COUNT(DISTINCT o_orderpriority) < COUNT(*) AS collapses FROM orders",
    "csv_guard": "SELECT CASE WHEN regexp_matches(question, '^[=+\\-@\\t\\r]') AND NOT regexp_matches(question, '^[+-]?\\d+([.,]\\d+)*([eE][+-]?\\d+)?$') THEN '''' || question ELSE question END AS cell FROM (SELECT DISTINCT question FROM audit_runs) q",
    "snapshot_retention": "SELECT id, report_id FROM (SELECT id, report_id, row_number() OVER (PARTITION BY report_id ORDER BY taken_at DESC, id DESC) AS rn FROM (SELECT DISTINCT id, report_id, taken_at FROM report_snapshots) s) x WHERE rn <= 3",
    "unique_keys": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", COUNT(*) = COUNT(DISTINCT {c}) AS u FROM {t}" for t, cs in (("region", ["r_regionkey", "r_name"]), ("nation", ["n_nationkey", "n_name", "n_regionkey"]), ("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]), ("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])) for c in cs) + ") x WHERE u",
}
SQL["unique_keys"] = SQL["unique_keys"].replace("SELECT * FROM (", 'SELECT "table", "column" FROM (', 1)

SQL["relationship_candidates"] = " UNION ALL ".join(
    f"SELECT '{t.name}' AS \"table\", '{r.column}' AS \"column\", '{r.target}' AS target, '{r.target_column}' AS target_column, round(COUNT(*) FILTER (WHERE {r.column} IN (SELECT {r.target_column} FROM {r.target})) / COUNT({r.column}), 4) AS rate FROM {t.name}"
    for t in STAR.tables
    for r in t.relationships
)
