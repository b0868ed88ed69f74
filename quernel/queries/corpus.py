"""Queries of the general operators for training data (problems 1, 2 and 7)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.operators.hierarchy import cut_loops, descendants, hierarchy, loop_descendants, threads
from quernel.operators.nested import flatten, flatten_record, records
from quernel.operators.sessions import micros, sessionize
from quernel.sources import read_table
from quernel.workspace import materialise

# -- 1: hierarchies -----------------------------------------------------------


def _runs_placed(spark: SparkSession, base: str, with_paths: bool) -> DataFrame:
    runs = read_table(spark, base, "audit_runs")
    return hierarchy(runs, "run_id", ["follow_up_of", "edited_from"], micros("created_at"), with_paths)


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    """Each linked run's topmost run and depth."""
    placed = _runs_placed(spark, base, False)
    return placed.where(F.col("parent_id").isNotNull()).select(F.col("node").alias("run_id"), "root_id", "depth")


def p1_paths(spark: SparkSession, base: str) -> DataFrame:
    """Every run with its path from the first run, written with '/'."""
    placed = _runs_placed(spark, base, True)
    return placed.select(F.col("node").alias("run_id"), "parent_id", "root_id", "depth", "in_loop", F.array_join("path", "/").alias("path"))


def p1_descendants(spark: SparkSession, base: str) -> DataFrame:
    """All later runs of every run in trees without loops, with the number of steps; p1_later_runs has all."""
    below = descendants(_runs_placed(spark, base, True))
    return below.select(F.col("ancestor_id").alias("run_id"), F.col("node").alias("later_run_id"), "distance")


def p1_loop_paths(spark: SparkSession, base: str) -> DataFrame:
    """Every run on or below a loop, with its path from the loop's smallest id, at which the loop is cut."""
    cut = cut_loops(_runs_placed(spark, base, False))
    return cut.select(
        F.col("node").alias("run_id"), "root_id", (F.size("path") - 1).alias("steps"),
        (F.size("path") == F.col("entry")).alias("on_loop"), F.array_join("path", "/").alias("path"), F.array_join("ring", "/").alias("loop"),
    )


def p1_later_runs(spark: SparkSession, base: str) -> DataFrame:
    """All later runs of every run, also on and below loops, with the fewest steps and whether the earlier run is on a loop."""
    placed = materialise(_runs_placed(spark, base, True), "placed")
    free = descendants(placed).withColumn("on_loop", F.lit(False))
    below = free.unionByName(loop_descendants(cut_loops(placed)))
    return below.select(F.col("ancestor_id").alias("run_id"), F.col("node").alias("later_run_id"), "distance", "on_loop")


def conversation_threads(spark: SparkSession, base: str) -> DataFrame:
    """Each run with the up to nine runs before it in its conversation, earliest first."""
    placed = materialise(_runs_placed(spark, base, True), "placed")
    pairs = descendants(placed).unionByName(loop_descendants(cut_loops(placed)).drop("on_loop"))
    return threads(pairs, placed, 10).select(F.col("node").alias("run_id"), F.array_join("thread", "/").alias("thread"))


_SQL_WALK = r"""
WITH RECURSIVE bare AS (
  SELECT nullif(lower(regexp_replace(run_id, '^\s+|\s+$', '', 'g')), '') AS node,
         coalesce(nullif(lower(regexp_replace(follow_up_of, '^\s+|\s+$', '', 'g')), ''),
                  nullif(lower(regexp_replace(edited_from, '^\s+|\s+$', '', 'g')), '')) AS parent
  FROM audit_runs),
nodes AS (SELECT node, min(parent) AS parent FROM bare WHERE node IS NOT NULL GROUP BY node),
links AS (SELECT node, parent FROM nodes WHERE parent IN (SELECT node FROM nodes)),
walk(node, here, trail) AS (
  SELECT node, parent, [node] FROM links
  UNION ALL
  SELECT w.node, l.parent, list_append(w.trail, w.here)
  FROM walk w JOIN links l ON l.node = w.here WHERE NOT list_contains(w.trail, w.here)),
ended AS (
  SELECT node, here, trail, list_contains(trail, here) AS in_loop FROM walk
  WHERE list_contains(trail, here) OR here NOT IN (SELECT node FROM links)),
placed AS (
  SELECT e.node AS run_id, l.parent AS parent_id, e.in_loop,
         CASE WHEN e.in_loop THEN list_min(e.trail[list_position(e.trail, e.here):]) ELSE e.here END AS root_id,
         CASE WHEN e.in_loop THEN -1 ELSE len(e.trail) END AS depth,
         CASE WHEN NOT e.in_loop THEN list_reverse(list_append(e.trail, e.here)) END AS ids
  FROM ended e JOIN links l USING (node))
"""

P1_SQL = {
    "p1_found": _SQL_WALK + "SELECT run_id, root_id, CAST(depth AS INTEGER) AS depth FROM placed",
    "p1_paths": _SQL_WALK
    + """SELECT run_id, parent_id, root_id, CAST(depth AS INTEGER) AS depth, in_loop, array_to_string(ids, '/') AS path FROM placed
UNION ALL SELECT node, NULL, node, 0, FALSE, node FROM nodes WHERE node NOT IN (SELECT node FROM links)""",
    "p1_loop_paths": _SQL_WALK
    + """, tops AS (SELECT e.node AS top, list_concat([e.node], list_reverse(e.trail[2:])) AS ring FROM ended e JOIN placed p ON p.run_id = e.node WHERE e.in_loop AND p.root_id = e.node),
cut AS (SELECT e.node, p.root_id, list_reverse(e.trail[:list_position(e.trail, p.root_id)]) AS ids FROM ended e JOIN placed p ON p.run_id = e.node WHERE e.in_loop)
SELECT c.node AS run_id, c.root_id, CAST(len(c.ids) - 1 AS INTEGER) AS steps, list_contains(t.ring, c.node) AS on_loop, array_to_string(c.ids, '/') AS path, array_to_string(t.ring, '/') AS loop
FROM cut c JOIN tops t ON t.top = c.root_id""",
    "p1_later_runs": _SQL_WALK
    + """, ringed AS (SELECT DISTINCT unnest(trail[list_position(trail, here):]) AS node FROM ended WHERE in_loop)
SELECT here AS run_id, node AS later_run_id, CAST(len(trail) AS INTEGER) AS distance, here IN (SELECT node FROM ringed) AS on_loop FROM walk WHERE NOT list_contains(trail, here)""",
    "conversation_threads": _SQL_WALK
    + """SELECT node AS run_id, array_to_string(list_reverse((CASE WHEN in_loop THEN trail ELSE list_append(trail, here) END)[:10]), '/') AS thread FROM ended
UNION ALL SELECT node, node FROM nodes WHERE node NOT IN (SELECT node FROM links)""",
    "p1_descendants": _SQL_WALK
    + """, pairs AS (SELECT run_id, depth, ids, unnest(range(1, depth + 1)) AS i FROM placed WHERE NOT in_loop)
SELECT ids[i] AS run_id, run_id AS later_run_id, CAST(depth - i + 1 AS INTEGER) AS distance FROM pairs""",
}

# -- 2: nested records --------------------------------------------------------


#: Places that hold lists in whatever shape, by column.
_LISTS = {
    "trace": ("trace.stages", "trace.events", "trace.stages.metadata.missing_relationships"),
    "model_detail": ("model_detail.missing_relationships", "model_detail.interpretations"),
    "cards": ("cards.rows",),
}


def _records(spark: SparkSession, base: str, table: str, key: str, *columns: str) -> DataFrame:
    return records(read_table(spark, base, table), key, list(columns))


def _flat(found: DataFrame, column: str) -> dict[str, DataFrame]:
    """All flat tables of a column, by name."""
    declared = dict.fromkeys(_LISTS[column], "list")
    if column == "cards":
        return flatten(found, "id", F.col(column), column, column, declared, "rec")
    return flatten_record(found, "id", F.col(column), column, declared, "rec")


def _all_flat(spark: SparkSession, base: str) -> list[tuple[str, str, dict[str, DataFrame]]]:
    """(table, column, flat tables) of all four columns."""
    out = []
    for table, key, columns in _NESTED:
        found = _records(spark, base, table, key, *columns)
        out += [(table, c, _flat(found, c)) for c in columns]
    return out


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    """Every element of the nested columns, by table, record and path, from the flat tables."""
    wanted = {
        ("audit_runs", "trace"): ("trace.stages", "trace.events"),
        ("audit_runs", "model_detail"): ("model_detail.missing_relationships", "model_detail.interpretations"),
        ("reports", "cards"): ("cards",),
        ("report_snapshots", "cards"): ("cards", "cards.rows"),
    }
    places = [(t, tables, wanted[t, c]) for t, c, tables in _all_flat(spark, base)]
    parts = [tables[n].select(F.lit(t).alias("parent_table"), "parent_id", "path") for t, tables, names in places for n in names if n in tables]
    return functools.reduce(DataFrame.unionByName, parts)


#: Table, key and columns of the records with nested values.
_NESTED = [("audit_runs", "run_id", ("trace", "model_detail")), ("reports", "id", ("cards",)), ("report_snapshots", "id", ("cards",))]
_NO_ROWS = "row_id string, parent_row_id string, parent_id string, parent_path string, path string, ordinal int, value_text string"


def _flat_table(spark: SparkSession, base: str, table: str, column: str, name: str) -> DataFrame:
    """One flat table with all its columns; without rows and typed columns where nothing stands there.

    Decimals come out as doubles, so that types don't change with the digits
    stored, and what has no one type as JSON text.
    """
    key = {t: k for t, k, _ in _NESTED}[table]
    found = _flat(_records(spark, base, table, key, column), column).get(name)
    if found is None:
        return spark.createDataFrame([], _NO_ROWS)

    def settled(c: str, kind: str) -> Column:
        v = F.col("`" + c.replace("`", "``") + "`")
        return (F.to_json(v) if kind == "variant" else v.cast("double") if kind.startswith("decimal") else v).alias(c)

    return found.select(*(settled(c, kind) for c, kind in found.dtypes))


def p2_stages(spark: SparkSession, base: str) -> DataFrame:
    """The flat table of trace stages; a stage that stands by key without a name has the key as its name."""
    stages = _flat_table(spark, base, "audit_runs", "trace", "trace.stages")
    kinds = dict(stages.dtypes)
    last = F.regexp_extract("path", "[^/]*$", 0)

    def field(f: str, kind: str) -> Column:
        c = f"f_{f}"
        if c not in kinds:
            return F.lit(None).cast(kind)
        return F.col(c).try_cast(kind)

    return stages.withColumnRenamed("parent_id", "run_id").select(
        "run_id", "path", "ordinal",
        F.coalesce(field("name", "string"), F.when(last.try_cast("int").isNull(), last)).alias("name"),
        field("status", "string").alias("status"),
        field("duration_ms", "double").alias("duration_ms"),
        field("reason", "string").alias("reason"),
        "row_id", "parent_row_id", "parent_path", "value_text",
        *(F.col("`" + c.replace("`", "``") + "`") for c in stages.columns if c.startswith("f_")),
    )


def p2_events(spark: SparkSession, base: str) -> DataFrame:
    """The flat table of trace events."""
    return _flat_table(spark, base, "audit_runs", "trace", "trace.events")


def p2_stage_missing_relationships(spark: SparkSession, base: str) -> DataFrame:
    """The flat table of the missing relationships that stages name, below their stage."""
    return _flat_table(spark, base, "audit_runs", "trace", "trace.stages.metadata.missing_relationships")


def p2_missing_relationships(spark: SparkSession, base: str) -> DataFrame:
    """The flat table of missing relationships."""
    return _flat_table(spark, base, "audit_runs", "model_detail", "model_detail.missing_relationships")


def p2_interpretations(spark: SparkSession, base: str) -> DataFrame:
    """The flat table of interpretations."""
    return _flat_table(spark, base, "audit_runs", "model_detail", "model_detail.interpretations")


def p2_report_cards(spark: SparkSession, base: str) -> DataFrame:
    """The flat table of report cards."""
    return _flat_table(spark, base, "reports", "cards", "cards")


def p2_snapshot_cards(spark: SparkSession, base: str) -> DataFrame:
    """The flat table of snapshot cards."""
    return _flat_table(spark, base, "report_snapshots", "cards", "cards")


def p2_snapshot_rows(spark: SparkSession, base: str) -> DataFrame:
    """The flat table of the rows of snapshot cards."""
    return _flat_table(spark, base, "report_snapshots", "cards", "cards.rows")


def p2_flat(spark: SparkSession, base: str) -> DataFrame:
    """The rows of all flat tables of all four columns, typed columns as one JSON object without nulls."""
    parts = []
    for table, _, tables in _all_flat(spark, base):
        for name, t in tables.items():
            typed = [c for c in t.columns if c.startswith("f_")]
            fields = F.to_json(F.struct(*(F.col("`" + c.replace("`", "``") + "`").alias(c) for c in typed))) if typed else F.lit("{}")
            parts.append(t.select(F.lit(table).alias("parent_table"), F.lit(name).alias("flat_table"), *_NO_ROWS.replace(",", "").split()[::2], fields.alias("fields")))
    return functools.reduce(DataFrame.unionByName, parts)


def p2_snapshot_tables(spark: SparkSession, base: str) -> DataFrame:
    """Row counts of all flat tables below report_snapshots.cards, found from the merged schema."""
    tables = _flat(_records(spark, base, "report_snapshots", "id", "cards"), "cards")
    parts = [t.groupBy().agg(F.lit(n).alias("flat_table"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct("parent_id").alias("n_records")) for n, t in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _sql_keys(p: str) -> str:
    """DuckDB: the keys of the elements at a place, a list."""
    at = lambda x: f"json_extract({p}, {x})"
    listed = f"list_filter(list_transform(range(CAST(json_array_length({p}) AS BIGINT)), lambda i: CASE WHEN json_type({at(chr(39) + '$[' + chr(39) + ' || i || ' + chr(39) + ']' + chr(39))}) <> 'NULL' THEN CAST(i AS VARCHAR) END), lambda x: x IS NOT NULL)"
    plain = f"len(list_filter(json_keys({p}), lambda k: json_type({at(_KEYED)}) <> 'OBJECT')) = 0"
    return f"CASE json_type({p}) WHEN 'ARRAY' THEN {listed} WHEN 'OBJECT' THEN CASE WHEN {plain} THEN json_keys({p}) ELSE ['0'] END ELSE [] END"


_KEYED = """'$."' || k || '"'"""


def _sql_decoded(text: str) -> str:
    """DuckDB: a text read through up to four encodings, as JSON; null if it isn't complete."""
    out = f"CASE WHEN json_valid({text}) THEN CAST({text} AS JSON) END"
    for _ in range(3):
        inner = f"json_extract_string({out}, '$')"
        out = f"CASE WHEN json_type({out}) = 'VARCHAR' THEN CASE WHEN json_valid({inner}) THEN CAST({inner} AS JSON) END ELSE {out} END"
    return out


def _sql_once(table: str, key: str, column: str) -> str:
    """DuckDB: each record once: id, its surrogate rec, the decoded column d."""
    texts = f"md5(coalesce(CAST(length({column}) AS VARCHAR) || ':' || {column}, '-'))"
    return f"SELECT id, md5('=' || id || chr(10) || {texts}) AS rec, {_sql_decoded(column)} AS d FROM (SELECT DISTINCT {key} AS id, {column} FROM {table}) r"


def _sql_p2() -> str:
    parts = []
    for column, fields in (("trace", ("stages", "events")), ("model_detail", ("missing_relationships", "interpretations"))):
        for f in fields:
            parts.append(f"SELECT 'audit_runs' AS parent_table, id AS parent_id, '{column}/{f}/' || unnest({_sql_keys('p')}) AS path FROM (SELECT id, json_extract(d, '$.{f}') AS p FROM ({_sql_once('audit_runs', 'run_id', column)}) a) b")
    parts.append(f"SELECT 'reports', id, 'cards/' || unnest({_sql_keys('d')}) FROM ({_sql_once('reports', 'id', 'cards')}) a")
    parts.append(f"SELECT 'report_snapshots', id, 'cards/' || k FROM ({_SQL_CARDS}) c")
    parts.append(f"SELECT 'report_snapshots', id, 'cards/' || k || '/rows/' || unnest({_sql_keys('p')}) FROM (SELECT id, k, json_extract(v, '$.rows') AS p FROM ({_SQL_CARDS}) c) e")
    return " UNION ALL ".join(parts)


def _sql_at(p: str, k: str) -> str:
    """DuckDB: the element with a key at a place."""
    return f"CASE WHEN json_type({p}) = 'ARRAY' THEN json_extract({p}, '$[' || {k} || ']') WHEN json_type(json_extract({p}, '$.\"' || {k} || '\"')) = 'OBJECT' THEN json_extract({p}, '$.\"' || {k} || '\"') ELSE {p} END"


_SQL_CARDS = f"SELECT id, k, {_sql_at('d', 'k')} AS v FROM (SELECT id, d, unnest({_sql_keys('d')}) AS k FROM ({_sql_once('report_snapshots', 'id', 'cards')}) a) b"


def _sql_elements(records_sql: str, place: str, above: str) -> str:
    """DuckDB: id, rec, above, k, o (ordinal), v of the elements at a place, an expression over d; ``above`` is the parent's path."""
    keys = f"SELECT *, list_sort(ks) AS sorted FROM (SELECT *, {_sql_keys('p')} AS ks FROM (SELECT *, {place} AS p FROM ({records_sql}) a) b) c"
    return f"SELECT id, rec, {above} AS above, k, coalesce(TRY_CAST(k AS INTEGER), CAST(list_position(sorted, k) - 1 AS INTEGER)) AS o, {_sql_at('p', 'k')} AS v FROM (SELECT *, unnest(ks) AS k FROM ({keys}) d) e"


def _sql_typed(f: str) -> str:
    """DuckDB: the column of a field, ``name`` or ``name:kind``; kind json is JSON text with its fields in order."""
    f, _, kind = f.partition(":")
    at = f"json_extract(v, '$.{f}')"
    if kind == "json":
        inside = f"list_transform(list_sort(json_keys({at})), lambda y: '\"' || y || '\":' || CAST(json_extract({at}, '$.\"' || y || '\"') AS VARCHAR))"
        value = f"CASE json_type({at}) WHEN 'OBJECT' THEN '{{' || array_to_string({inside}, ',') || '}}' ELSE CAST({at} AS VARCHAR) END"
    else:
        value = f"json_extract_string(v, '$.{f}')" if not kind else f"CAST(json_extract_string(v, '$.{f}') AS {kind})"
    return f", CASE WHEN json_type(v) = 'OBJECT' THEN {value} END AS f_{f}"


def _sql_flat(elements_sql: str, field: str, fields: list[str], mixed: bool) -> str:
    """DuckDB: the flat table of elements; ``field`` is where they stand below ``above``."""
    path = f"above || '/{field}/' || k" if field else "above || '/' || k"
    text = "CASE WHEN json_type(v) <> 'OBJECT' THEN v->>'$' END" if mixed else "CAST(NULL AS VARCHAR)"
    typed = "".join(map(_sql_typed, fields))
    return f"SELECT md5(rec || chr(10) || {path}) AS row_id, md5(rec || chr(10) || above) AS parent_row_id, id AS parent_id, above AS parent_path, {path} AS path, o AS ordinal, {text} AS value_text{typed} FROM ({elements_sql}) x"


_SQL_TRACE, _SQL_DETAIL = _sql_once("audit_runs", "run_id", "trace"), _sql_once("audit_runs", "run_id", "model_detail")
_SQL_STAGES = _sql_elements(_SQL_TRACE, "json_extract(d, '$.stages')", "'trace'")
_REPORT_FIELDS = ["basis:json", "chart", "dimension:json", "display:json", "id", "kind", "layout:json", "note", "question", "run_id", "sql", "title"]
_SNAPPED = _sql_elements(_sql_once("report_snapshots", "id", "cards"), "d", "'cards'")
P2_SQL = {
    "p2_found": _sql_p2(),
    "p2_stages": "SELECT parent_id AS run_id, path, ordinal, coalesce(f_name, CASE WHEN TRY_CAST(regexp_extract(path, '[^/]*$') AS INTEGER) IS NULL THEN regexp_extract(path, '[^/]*$') END) AS name, f_status AS status, f_duration_ms AS duration_ms, f_reason AS reason, row_id, parent_row_id, parent_path, value_text, f_duration_ms, f_label, f_metadata, f_name, f_reason, f_status FROM ("
    + _sql_flat(_SQL_STAGES, "stages", ["duration_ms:DOUBLE", "label", "metadata:json", "name", "reason", "status"], False)
    + ") s",
    "p2_report_cards": _sql_flat(_sql_elements(_sql_once("reports", "id", "cards"), "d", "'cards'"), "", _REPORT_FIELDS, False),
    "p2_snapshot_cards": _sql_flat(_SNAPPED, "", ["basis:json", "outcome", "reason", "row_count:BIGINT", "run_id"], False),
    "p2_snapshot_rows": _sql_flat(_sql_elements(f"SELECT id, rec, 'cards/' || k AS card, v AS d FROM ({_SNAPPED}) s", "json_extract(d, '$.rows')", "card"), "rows", ["label", "value:DOUBLE"], False),
    "p2_events": _sql_flat(_sql_elements(_SQL_TRACE, "json_extract(d, '$.events')", "'trace'"), "events", ["at", "event_id", "event_type", "message", "stage"], False),
    "p2_stage_missing_relationships": _sql_flat(
        _sql_elements(f"SELECT id, rec, 'trace/stages/' || k AS stage, v AS d FROM ({_SQL_STAGES}) s", "json_extract(d, '$.metadata.missing_relationships')", "stage"), "metadata/missing_relationships", [], True
    ),
    "p2_missing_relationships": _sql_flat(_sql_elements(_SQL_DETAIL, "json_extract(d, '$.missing_relationships')", "'model_detail'"), "missing_relationships", ["from_table", "to_table"], True),
    "p2_interpretations": _sql_flat(_sql_elements(_SQL_DETAIL, "json_extract(d, '$.interpretations')", "'model_detail'"), "interpretations", [], True),
    "p2_snapshot_tables": f"""WITH cards AS ({_SQL_CARDS}), listed AS (SELECT id, json_extract(v, '$.rows') AS r, json_extract(v, '$.columns') AS c FROM cards)
SELECT 'cards' AS flat_table, COUNT(*) AS n_rows, COUNT(DISTINCT id) AS n_records FROM cards
UNION ALL SELECT 'cards.rows', CAST(SUM(n) AS BIGINT), COUNT(DISTINCT id) FILTER (WHERE n > 0) FROM (SELECT id, len({_sql_keys("r")}) AS n FROM listed) a
UNION ALL SELECT 'cards.columns', CAST(SUM(n) AS BIGINT), COUNT(DISTINCT id) FILTER (WHERE n > 0) FROM (SELECT id, len({_sql_keys("c")}) AS n FROM listed) a""",
}


# -- 7: sessions --------------------------------------------------------------


def _sessions(spark: SparkSession, base: str) -> DataFrame:
    return sessionize(read_table(spark, base, "audit_runs"), "actor", "created_at", "run_id", 30, 15)


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    """Each actor's sessions by first and last run."""
    return _sessions(spark, base).select("actor", F.col("first_event").alias("first_run_id"), F.col("last_event").alias("last_run_id"), F.col("n_events").alias("n_runs"))


def p7_sessions(spark: SparkSession, base: str) -> DataFrame:
    """Each actor's sessions with start, end, duration and run count."""
    return _sessions(spark, base).select("actor", "session_start", "session_end", F.round("duration_s", 3).alias("duration_s"), F.col("n_events").alias("n_runs"))


_SQL_SESSIONS = """
WITH runs AS (SELECT DISTINCT lower(actor) AS actor, created_at, run_id FROM audit_runs WHERE created_at IS NOT NULL),
marked AS (
  SELECT *, CASE WHEN created_at - lag(created_at) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts
  FROM runs WINDOW w AS (PARTITION BY actor ORDER BY created_at, run_id)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY actor ORDER BY created_at, run_id ROWS UNBOUNDED PRECEDING) AS s FROM marked)
"""

P7_SQL = {
    "p7_found": _SQL_SESSIONS
    + """SELECT actor, arg_min(run_id, (created_at, run_id)) AS first_run_id, arg_max(run_id, (created_at, run_id)) AS last_run_id,
CAST(count(*) AS BIGINT) AS n_runs FROM numbered GROUP BY actor, s""",
    "p7_sessions": _SQL_SESSIONS
    + """SELECT actor, min(created_at) AS session_start, max(created_at) AS session_end,
round((epoch_us(max(created_at)) - epoch_us(min(created_at))) / 1e6, 3) AS duration_s, CAST(count(*) AS BIGINT) AS n_runs FROM numbered GROUP BY actor, s""",
}

QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_paths, p1_descendants, p1_loop_paths, p1_later_runs, conversation_threads,
        p2_found, p2_stages, p2_events, p2_stage_missing_relationships, p2_missing_relationships, p2_interpretations,
        p2_report_cards, p2_snapshot_cards, p2_snapshot_rows, p2_flat, p2_snapshot_tables,
        p7_found, p7_sessions,
    )
}
SQL = P1_SQL | P2_SQL | P7_SQL
