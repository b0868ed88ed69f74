"""The relational surface: scans, predicates, joins, aggregates, windows, sorts, set operations and functions.

Each query is declarative Spark SQL or DataFrame code over pruned scans; the
SQL beside it is what DuckDB runs on the same tables. Where both dialects agree
the text is the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernel.sources import read_table

TABLES = "region nation customer supplier part orders lineitem events".split()

# name -> (Spark SQL, SQL for DuckDB or None where it is the same)
SQL_PAIRS: dict[str, tuple[str, str | None]] = {
    "flagship": (
        """WITH li AS (SELECT l_orderkey, SUM(l_extendedprice * (1 - l_discount)) AS net, COUNT(*) AS n_lines FROM lineitem GROUP BY l_orderkey)
SELECT r.r_name AS region, c.c_mktsegment AS segment, COUNT(*) AS n_orders, ROUND(SUM(o.o_totalprice), 2) AS gross,
       ROUND(SUM(li.net), 2) AS net, CAST(SUM(li.n_lines) AS BIGINT) AS n_lines
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN li ON li.l_orderkey = o.o_orderkey
WHERE o.o_orderstatus = 'F' GROUP BY r.r_name, c.c_mktsegment""",
        None,
    ),
    "scan_filter_project": (
        "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, ROUND(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01 00:00:00' AND l_quantity >= 45 AND NOT (l_returnflag = 'R')",
        None,
    ),
    "in_between_like": (
        "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 100000 AND 200000 AND o_orderpriority LIKE '1%' AND o_orderpriority NOT ILIKE '%LOW%'",
        None,
    ),
    "null_predicates": (
        "SELECT c_custkey, NULLIF(c_mktsegment, 'BUILDING') AS segment, COALESCE(NULLIF(c_mktsegment, 'BUILDING'), 'none') AS filled FROM customer WHERE NULLIF(c_mktsegment, 'BUILDING') IS NULL OR c_acctbal IS NOT NULL AND c_acctbal < 0",
        None,
    ),
    "case_cast": (
        "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class, CAST(p_retailprice AS INT) - CAST(p_retailprice AS INT) % 100 AS price_step, COUNT(*) AS n FROM part GROUP BY 1, 2",
        "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class, CAST(trunc(p_retailprice) AS INT) - CAST(trunc(p_retailprice) AS INT) % 100 AS price_step, COUNT(*) AS n FROM part GROUP BY 1, 2",
    ),
    "arithmetic_concat": (
        "SELECT p_partkey, p_brand || '/' || p_type AS label, p_size div 7 AS whole, p_size % 7 AS rest, ROUND(p_retailprice * 1.19, 4) AS gross, -p_size AS minus FROM part WHERE p_size + 1 > 40",
        "SELECT p_partkey, p_brand || '/' || p_type AS label, CAST(p_size // 7 AS BIGINT) AS whole, p_size % 7 AS rest, ROUND(p_retailprice * 1.19, 4) AS gross, -p_size AS minus FROM part WHERE p_size + 1 > 40",
    ),
    "exists_semi": ("SELECT c.c_custkey, c.c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)", None),
    "not_exists_anti": ("SELECT c.c_custkey, c.c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')", None),
    "in_subquery": ("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3)) AND s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50)", None),
    "inner_left_join": (
        "SELECT o.o_orderkey, COUNT(l.l_orderkey) AS n_lines, ROUND(SUM(l.l_extendedprice), 2) AS total FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN customer c ON c.c_custkey = o.o_custkey WHERE c.c_mktsegment = 'MACHINERY' GROUP BY o.o_orderkey",
        None,
    ),
    "right_full_join": (
        """SELECT coalesce(a.k, b.k) AS k, a.n AS n_customers, b.n AS n_suppliers
FROM (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer WHERE c_nationkey < 15 GROUP BY c_nationkey) a
FULL OUTER JOIN (SELECT n.n_nationkey AS k, COUNT(s.s_suppkey) AS n FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE n.n_nationkey > 5 GROUP BY n.n_nationkey) b ON a.k = b.k""",
        None,
    ),
    "using_join": ("SELECT k, a.n AS n_customers, b.n AS n_suppliers FROM (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY 1) a JOIN (SELECT s_nationkey AS k, COUNT(*) AS n FROM supplier GROUP BY 1) b USING (k)", None),
    "self_join_pairs": ("SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "theta_join": ("SELECT o.o_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_extendedprice > o.o_totalprice * 0.9", None),
    "cross_one_row_avg": ("SELECT c_custkey, ROUND(c_acctbal - m.mean, 4) AS above FROM customer CROSS JOIN (SELECT AVG(c_acctbal) AS mean FROM customer) m WHERE c_acctbal > m.mean", None),
    "correlated_scalar": ("SELECT p.p_partkey, p.p_retailprice FROM part p WHERE p.p_retailprice > (SELECT AVG(q.p_retailprice) * 1.05 FROM part q WHERE q.p_brand = p.p_brand)", None),
    "lateral_values": (
        "SELECT n.n_name, v.kind, v.k FROM nation n, LATERAL (SELECT 'nation' AS kind, n.n_nationkey AS k UNION ALL SELECT 'region', n.n_regionkey) AS v",
        "SELECT n_name, 'nation' AS kind, n_nationkey AS k FROM nation UNION ALL SELECT n_name, 'region', n_regionkey FROM nation",
    ),
    "unnest_relation": (
        "SELECT p_partkey, word FROM part LATERAL VIEW explode(split(p_type, ' ')) w AS word WHERE p_size = 1",
        "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part WHERE p_size = 1",
    ),
    "nested_cte": (
        "WITH a AS (SELECT o_custkey AS k, SUM(o_totalprice) AS t FROM orders GROUP BY o_custkey), b (k, t, d) AS (SELECT k, t, t / 1000 FROM a WHERE t > 500000), c AS (WITH inn AS (SELECT k, d FROM b) SELECT * FROM inn) SELECT k, ROUND(d, 6) AS d FROM c",
        None,
    ),
    "agg_basic": (
        """SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_price,
ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, ROUND(AVG(l_quantity), 6) AS avg_qty, MIN(l_shipdate) AS first_ship, MAX(l_shipdate) AS last_ship,
COUNT(*) AS n, COUNT(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY l_returnflag, l_linestatus""",
        None,
    ),
    "agg_distinct": ("SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts, ROUND(SUM(DISTINCT l_quantity), 2) AS distinct_qty, COUNT(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY l_returnflag", None),
    "agg_stats": (
        "SELECT l_linestatus, ROUND(stddev(l_quantity), 6) AS sd, ROUND(corr(l_quantity, l_extendedprice), 6) AS r, ROUND(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY l_linestatus",
        None,
    ),
    "percentiles": (
        """SELECT c_mktsegment, ROUND(percentile_cont(0.5) WITHIN GROUP (ORDER BY c_acctbal), 4) AS median, ROUND(percentile_cont(0.9) WITHIN GROUP (ORDER BY c_acctbal), 4) AS p90,
percentile_disc(0.25) WITHIN GROUP (ORDER BY c_acctbal) AS q1 FROM customer GROUP BY c_mktsegment""",
        None,
    ),
    "mode_lowest": (
        "SELECT c_mktsegment, MIN(c_nationkey) AS common_nation FROM (SELECT c_mktsegment, c_nationkey, COUNT(*) AS n, MAX(COUNT(*)) OVER (PARTITION BY c_mktsegment) AS most FROM customer GROUP BY c_mktsegment, c_nationkey) x WHERE n = most GROUP BY c_mktsegment",
        None,
    ),
    "listagg_sorted": (
        "SELECT r.r_name, listagg(n.n_name, ', ') WITHIN GROUP (ORDER BY n.n_name) AS nations, size(array_agg(n.n_nationkey)) AS n FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name",
        "SELECT r.r_name, string_agg(n.n_name, ', ' ORDER BY n.n_name) AS nations, CAST(len(array_agg(n.n_nationkey)) AS INT) AS n FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name",
    ),
    "json_aggs": (
        "SELECT r.r_name, to_json(sort_array(collect_list(n.n_name))) AS names FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name",
        "SELECT r.r_name, '[\"' || string_agg(n.n_name, '\",\"' ORDER BY n.n_name) || '\"]' AS names FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name",
    ),
    "bool_aggs": ("SELECT o_orderpriority, bool_and(o_totalprice > 1000) AS all_big, bool_or(o_totalprice > 480000) AS some_huge FROM orders GROUP BY o_orderpriority", None),
    "agg_filter": ("SELECT o_orderstatus, COUNT(*) FILTER (WHERE o_orderpriority LIKE '1%') AS urgent, ROUND(SUM(o_totalprice) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'), 2) AS late_total FROM orders GROUP BY o_orderstatus", None),
    "having": ("SELECT o_custkey, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND SUM(o_totalprice) > 1000000", None),
    "grouping_sets": ("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", None),
    "rollup": ("SELECT r.r_name, n.n_name, COUNT(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY ROLLUP (r.r_name, n.n_name)", None),
    "cube": ("SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", None),
    "distinct_rows": ("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem", None),
    "distinct_on": (
        "SELECT c_mktsegment, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) x WHERE rn = 1",
        "SELECT DISTINCT ON (c_mktsegment) c_mktsegment, c_custkey, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey",
    ),
    "preagg_child_measure": (
        "WITH li AS (SELECT l_orderkey, SUM(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey) SELECT o.o_orderstatus, ROUND(SUM(o.o_totalprice), 2) AS total, ROUND(SUM(li.qty), 2) AS qty FROM orders o LEFT JOIN li ON li.l_orderkey = o.o_orderkey GROUP BY o.o_orderstatus",
        None,
    ),
    "win_ranking": (
        """SELECT n_nationkey, n_regionkey, n, row_number() OVER w AS rn, rank() OVER (PARTITION BY n_regionkey ORDER BY n DESC) AS rk, dense_rank() OVER (PARTITION BY n_regionkey ORDER BY n DESC) AS dr,
ROUND(percent_rank() OVER (PARTITION BY n_regionkey ORDER BY n DESC), 6) AS pr, ntile(3) OVER w AS bucket
FROM (SELECT n.n_nationkey, n.n_regionkey, COUNT(*) AS n FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_nationkey, n.n_regionkey) x WINDOW w AS (PARTITION BY n_regionkey ORDER BY n DESC, n_nationkey)""",
        """SELECT n_nationkey, n_regionkey, n, CAST(row_number() OVER w AS INT) AS rn, CAST(rank() OVER (PARTITION BY n_regionkey ORDER BY n DESC) AS INT) AS rk, CAST(dense_rank() OVER (PARTITION BY n_regionkey ORDER BY n DESC) AS INT) AS dr,
ROUND(percent_rank() OVER (PARTITION BY n_regionkey ORDER BY n DESC), 6) AS pr, CAST(ntile(3) OVER w AS INT) AS bucket
FROM (SELECT n.n_nationkey, n.n_regionkey, COUNT(*) AS n FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_nationkey, n.n_regionkey) x WINDOW w AS (PARTITION BY n_regionkey ORDER BY n DESC, n_nationkey)""",
    ),
    "win_lag_lead": (
        """SELECT o_custkey, o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice, 2, -1.0) OVER w AS after, first_value(o_orderkey) OVER w AS first_order,
last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_order,
nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_order
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
        None,
    ),
    "win_running": (
        """SELECT o_custkey, o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running,
ROUND(AVG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving, COUNT(*) OVER (PARTITION BY o_custkey) AS n,
COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_totalprice RANGE BETWEEN 10000 PRECEDING AND 10000 FOLLOWING) AS close_orders FROM orders""",
        None,
    ),
    "topk_nulls_last": (
        "SELECT c_custkey, NULLIF(c_acctbal, 0) AS bal FROM customer ORDER BY NULLIF(c_acctbal, 0) ASC NULLS LAST, c_custkey LIMIT 20",
        None,
    ),
    "limit_offset": ("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 15 OFFSET 10", None),
    "ties_at_max": ("SELECT p_partkey, p_size FROM part WHERE p_size = (SELECT MAX(p_size) FROM part)", None),
    "union_all": ("SELECT c_nationkey AS k, 'c' AS kind FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier", None),
    "union_distinct": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "intersect": ("SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0", None),
    "except": ("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'", None),
    "except_all": ("SELECT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A'", None),
    "fn_datetime": (
        """SELECT o_orderkey, CAST(CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS STRING) AS month, CAST(extract(YEAR FROM o_orderdate) AS INT) AS y, CAST(date_part('quarter', o_orderdate) AS INT) AS q,
CAST(make_date(2020, 2, 29) AS STRING) AS leap, CAST(to_date('2021-03-04', 'yyyy-MM-dd') AS STRING) AS parsed, date_format(o_orderdate, 'yyyy-MM') AS label, datediff(DATE '2002-01-01', CAST(o_orderdate AS DATE)) AS age_days FROM orders""",
        """SELECT o_orderkey, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS month, CAST(extract(YEAR FROM o_orderdate) AS INT) AS y, CAST(date_part('quarter', o_orderdate) AS INT) AS q,
CAST(make_date(2020, 2, 29) AS VARCHAR) AS leap, '2021-03-04' AS parsed, strftime(o_orderdate, '%Y-%m') AS label, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS INT) AS age_days FROM orders""",
    ),
    "fn_numeric": (
        """SELECT c_custkey, abs(c_acctbal) AS a, CAST(ceil(c_acctbal) AS BIGINT) AS up, CAST(floor(c_acctbal) AS BIGINT) AS down, greatest(c_acctbal, 0.0) AS g, least(c_acctbal, 100.0) AS l, ROUND(ln(abs(c_acctbal) + 1), 6) AS ln1,
ROUND(log10(abs(c_acctbal) + 1), 6) AS log1, ROUND(exp(c_acctbal / 10000), 6) AS ex, ROUND(power(c_acctbal, 2), 4) AS sq, CAST(sign(c_acctbal) AS INT) AS sg, ROUND(sqrt(abs(c_acctbal)), 6) AS root, ROUND(c_acctbal, 1) AS r1,
sign(c_acctbal) * floor(abs(c_acctbal) * 10) / 10 AS truncated, nullif(c_nationkey, 3) AS nn FROM customer""",
        """SELECT c_custkey, abs(c_acctbal) AS a, CAST(ceil(c_acctbal) AS BIGINT) AS up, CAST(floor(c_acctbal) AS BIGINT) AS down, greatest(c_acctbal, 0.0) AS g, least(c_acctbal, 100.0) AS l, ROUND(ln(abs(c_acctbal) + 1), 6) AS ln1,
ROUND(log10(abs(c_acctbal) + 1), 6) AS log1, ROUND(exp(c_acctbal / 10000), 6) AS ex, ROUND(power(c_acctbal, 2), 4) AS sq, CAST(sign(c_acctbal) AS INT) AS sg, ROUND(sqrt(abs(c_acctbal)), 6) AS root, ROUND(c_acctbal, 1) AS r1,
sign(c_acctbal) * floor(abs(c_acctbal) * 10) / 10 AS truncated, nullif(c_nationkey, 3) AS nn FROM customer""",
    ),
    "fn_string": (
        """SELECT p_partkey, concat_ws('', p_brand, NULL, p_type) AS joined, concat_ws('-', p_brand, p_type) AS dashed, initcap(lower(p_type)) AS init, left(p_type, 4) AS l4, right(p_type, 3) AS r3, upper(p_name) AS up, reverse(p_brand) AS rev,
replace(p_type, 'A', '4') AS rep, translate(p_brand, 'Bd', 'bD') AS tr, split_part(p_type, ' ', 1) AS part1, length(p_name) AS len, btrim('  x ') AS bt, ltrim('  x') AS lt, trim(BOTH '#' FROM p_brand) AS tb, lpad(CAST(p_size AS STRING), 4, '0') AS lp,
rpad(p_brand, 10, '.') AS rp, substring(p_type, 2, 3) AS sub, position('a' IN lower(p_type)) AS pos, startswith(p_brand, 'Brand') AS sw, array_join(split(p_type, ' '), '+') AS plus FROM part""",
        """SELECT p_partkey, p_brand || p_type AS joined, concat_ws('-', p_brand, p_type) AS dashed, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS init, left(p_type, 4) AS l4, right(p_type, 3) AS r3, upper(p_name) AS up, reverse(p_brand) AS rev,
replace(p_type, 'A', '4') AS rep, translate(p_brand, 'Bd', 'bD') AS tr, split_part(p_type, ' ', 1) AS part1, CAST(length(p_name) AS INT) AS len, 'x' AS bt, 'x' AS lt, trim(p_brand, '#') AS tb, lpad(CAST(p_size AS VARCHAR), 4, '0') AS lp,
rpad(p_brand, 10, '.') AS rp, substring(p_type, 2, 3) AS sub, CAST(position('a' IN lower(p_type)) AS INT) AS pos, starts_with(p_brand, 'Brand') AS sw, replace(p_type, ' ', '+') AS plus FROM part""",
    ),
    "fn_array": (
        "SELECT p_partkey, size(split(p_type, ' ')) AS n, split(p_type, ' ')[0] AS first_word, array_join(array_remove(split(p_type, ' '), 'STEEL'), ' ') AS no_steel, cardinality(array(1, 2, p_size)) AS c FROM part",
        "SELECT p_partkey, CAST(len(string_split(p_type, ' ')) AS INT) AS n, string_split(p_type, ' ')[1] AS first_word, array_to_string(list_filter(string_split(p_type, ' '), lambda x: x <> 'STEEL'), ' ') AS no_steel, 3 AS c FROM part",
    ),
    "fn_json": (
        "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k, variant_get(parse_json(props), '$.k', 'int') AS k2, to_json(named_struct('type', event_type, 'user', user_id)) AS built FROM events",
        "SELECT event_id, CAST(props->>'$.k' AS INT) AS k, CAST(props->>'$.k' AS INT) AS k2, '{\"type\":\"' || event_type || '\",\"user\":' || user_id || '}' AS built FROM events",
    ),
    "events_daily": (
        "SELECT CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS day, event_type, COUNT(*) AS n, COUNT(DISTINCT user_id) AS users, ROUND(SUM(value), 4) AS total FROM events GROUP BY CAST(ts AS DATE), event_type",
        None,
    ),
    "stable_now": (
        "SELECT current_timestamp() = now() AS same_now, current_date() = CAST(current_timestamp() AS DATE) AS same_day, COUNT(*) AS n FROM region",
        "SELECT TRUE AS same_now, TRUE AS same_day, COUNT(*) AS n FROM region",
    ),
}


def run_sql(spark: SparkSession, base: str, text: str) -> DataFrame:
    """The query over the tables that it names, read with the columns it needs."""
    for t in TABLES:
        if t in text:
            read_table(spark, base, t).createOrReplaceTempView(t)
    return spark.sql(text)


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, base: run_sql(spark, base, text)


def tumbling_events(spark: SparkSession, base: str) -> DataFrame:
    """Six-hour windows over the event stream, in batch."""
    events = read_table(spark, base, "events")
    w = F.window("ts", "6 hours")
    return events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 4).alias("highest")).select(F.col("w.start").alias("start"), "event_type", "n", "highest")


def duplicate_names(spark: SparkSession, base: str) -> DataFrame:
    """Repeated output names made unique."""
    from quernel.plans.execute import unique_names

    df = run_sql(spark, base, "SELECT o_orderstatus, SUM(o_totalprice) AS sum, SUM(o_shippriority) AS sum FROM (SELECT *, 1 AS o_shippriority FROM orders) GROUP BY o_orderstatus")
    df = df.toDF(*unique_names(df.columns))
    return df.select("o_orderstatus", F.round("sum", 2).alias("sum"), F.col("sum_2").cast("long").alias("sum_2"))


def last_per_customer(spark: SparkSession, base: str) -> DataFrame:
    """Each customer's latest order, by a window over the pruned scan."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    orders = read_table(spark, base, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return orders.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _query(s) for k, (s, _) in SQL_PAIRS.items()}
QUERIES |= {f.__name__: f for f in (tumbling_events, duplicate_names, last_per_customer)}

SQL = {k: d or s for k, (s, d) in SQL_PAIRS.items()} | {
    "tumbling_events": "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, COUNT(*) AS n, round(max(value), 4) AS highest FROM events GROUP BY 1, 2",
    "duplicate_names": "SELECT o_orderstatus, round(SUM(o_totalprice), 2) AS sum, CAST(COUNT(*) AS BIGINT) AS sum_2 FROM orders GROUP BY o_orderstatus",
    "last_per_customer": "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) x WHERE rn = 1",
}
