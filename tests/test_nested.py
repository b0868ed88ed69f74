"""The flat tables of nested JSON against a plain recursion in Python."""

import json

from pyspark.sql import functions as F

from quernel.operators.nested import child_table, decoded, element_paths, flatten, flatten_record, object_fields, place, unwrapped
from quernel.queries.corpus import p2_found


def load(text):
    for _ in range(4):
        if not isinstance(text, str):
            return text
        try:
            text = json.loads(text)
        except ValueError:
            return None
    return text


def through(v):
    if isinstance(v, str):
        try:
            return json.loads(v)
        except ValueError:
            return v
    return v


def parts(v, path):
    if isinstance(v, list):
        return [(f"{path}/{i}", x) for i, x in enumerate(v) if x is not None]
    if isinstance(v, dict):
        if all(isinstance(x, dict) for x in v.values()):
            return [(f"{path}/{k}", x) for k, x in v.items()]
        return [(f"{path}/0", v)]
    return []


def brute(spark, base):
    rows = set()
    read = lambda t: spark.read.parquet(f"{base}/{t}.parquet").collect()
    for r in read("audit_runs"):
        for col, fields in (("trace", ("stages", "events")), ("model_detail", ("missing_relationships", "interpretations"))):
            v = load(r[col])
            if isinstance(v, dict):
                rows |= {("audit_runs", r["run_id"], p) for f in fields for p, _ in parts(through(v.get(f)), f"{col}/{f}")}
    for r in read("reports"):
        rows |= {("reports", r["id"], p) for p, _ in parts(load(r["cards"]), "cards")}
    for r in read("report_snapshots"):
        for p, x in parts(load(r["cards"]), "cards"):
            rows.add(("report_snapshots", r["id"], p))
            x = through(x)
            if isinstance(x, dict):
                rows |= {("report_snapshots", r["id"], q) for q, _ in parts(through(x.get("rows")), f"{p}/rows")}
    return rows


def test_found_equals_recursion(spark, sf):
    got = [tuple(r) for r in p2_found(spark, sf).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(spark, sf)


CASES = {
    "array": ('[{"a":1},null,"x",3]', ["c/0", "c/2", "c/3"]),
    "by key": ('{"k1":{"a":1},"k2":{}}', ["c/k1", "c/k2"]),
    "empty object": ("{}", []),
    "one element": ('{"a":1,"b":{}}', ["c/0"]),
    "null among objects": ('{"a":{},"b":null}', ["c/0"]),
    "twice": (json.dumps('[{"a":1}]'), ["c/0"]),
    "thrice": (json.dumps(json.dumps("[1,2]")), ["c/0", "c/1"]),
    "cut off": ('[{"a":1},{"b":', []),
    "trailing": ("[1] x", []),
    "words": ("n/a", []),
    "null": ("null", []),
    "scalar": ("7", []),
    "empty": ("", []),
    "blank": ("  ", []),
    "none": (None, []),
    "padded": (" \n[ 1 ]\n", ["c/0"]),
    "long": (json.dumps(["x" * 200_000] * 3), ["c/0", "c/1", "c/2"]),
}


def test_shapes(spark):
    df = spark.createDataFrame([(k, t, "clash") for k, (t, _) in CASES.items()], "id string, text string, path string")
    got = {r[0]: r[1] for r in df.select("id", element_paths(decoded(F.col("text")), "c")).collect()}
    assert {k: sorted(v) for k, v in got.items()} == {k: w for k, (_, w) in CASES.items()}


def test_encoded_inside(spark):
    df = spark.createDataFrame([("a", json.dumps({"s": json.dumps([1, 2])}))], "id string, text string")
    v = unwrapped(place(decoded(F.col("text")), "s"))
    assert [r[0] for r in child_table(df, "id", v, "t/s").select("path").collect()] == ["t/s/0", "t/s/1"]


def test_flatten_recurses(spark):
    doc = {"rows": [{"x": 1, "tags": ["p", "q"]}, {"x": 2.5, "y": "z"}]}
    df = spark.createDataFrame([("a", json.dumps(doc)), ("b", None)], "id string, text string")
    v = place(decoded(F.col("text")), "rows")
    tables = flatten(df, "id", v, "rows", "rows")
    assert sorted(tables) == ["rows", "rows.tags"]
    rows = {r["path"]: r for r in tables["rows"].collect()}
    assert rows["rows/0"]["f_x"] == 1 and rows["rows/1"]["f_y"] == "z" and rows["rows/0"]["ordinal"] == 0
    tags = {r["path"]: (r["parent_path"], r["value_text"]) for r in tables["rows.tags"].collect()}
    assert tags == {"rows/0/tags/0": ("rows/0", "p"), "rows/0/tags/1": ("rows/0", "q")}


def test_flatten_of_nothing(spark):
    df = spark.createDataFrame([], "id string, text string")
    tables = flatten(df, "id", decoded(F.col("text")), "c", "c")
    assert tables["c"].count() == 0


def test_object_fields():
    assert object_fields("OBJECT<a: BIGINT, b: ARRAY<OBJECT<c: STRING, d: DECIMAL(3,1)>>>") == {"a": "BIGINT", "b": "ARRAY<OBJECT<c: STRING, d: DECIMAL(3,1)>>"}
    assert object_fields("VARIANT") == {}


def test_found_comes_from_the_flat_tables(spark, sf, monkeypatch):
    """p2_found's rows are rows of tables made by the operator, each with its surrogate key."""
    from quernel.queries import corpus

    made = {}
    flat = corpus._flat
    monkeypatch.setattr(corpus, "_flat", lambda records, column: made.setdefault((column, "cards.rows" in (t := flat(records, column))), t))
    got = {tuple(r) for r in p2_found(spark, sf).collect()}
    assert {c for c, _ in made} == {"trace", "model_detail", "cards"} and len(made) == 4
    tables = {3: made["cards", True]}
    rows = tables[3]["cards.rows"].select("row_id", "parent_row_id", "parent_id", "path").collect()
    assert rows and {("report_snapshots", r["parent_id"], r["path"]) for r in rows} <= got
    assert len({r["row_id"] for r in rows}) == len(rows)
    assert {r["parent_row_id"] for r in rows} <= {r["row_id"] for r in tables[3]["cards"].select("row_id").collect()}


DEEP = [
    {"s": [{"m": {"rel": ["a", None, {"x": 1.25}]}, "it's": [1]}, "word"], "o": {"p": {"q": [[1, 2], [3]]}}},
    {"s": [{"m": {"rel": []}, "k": [7]}, {"k": {"deep": [8]}}, {"k": json.dumps([9])}, {"k": 5}], "o": [{"z": 1}]},
    {"s": None},
]


def lists(v, path):
    """Paths of the elements of all lists below; texts that hold a list are read through."""
    v = through(v)
    if isinstance(v, list):
        return [q for i, x in enumerate(v) if x is not None for q in (f"{path}/{i}", *lists(x, f"{path}/{i}"))]
    if isinstance(v, dict):
        return [q for k, x in v.items() for q in lists(x, f"{path}/{k}")]
    return []


def test_every_list_below_objects_and_mixed_shapes(spark):
    df = spark.createDataFrame([(str(i), json.dumps(d)) for i, d in enumerate(DEEP)], "id string, text string")
    tables = flatten_record(df, "id", decoded(F.col("text")), "c")
    got = sorted((r["parent_id"], r["path"]) for n, t in tables.items() if n != "c" for r in t.collect())
    assert got == sorted((str(i), p) for i, d in enumerate(DEEP) for p in lists(d, "c"))
    assert {"c.s", "c.s.m.rel", "c.s.k", "c.s.k.deep", "c.s.it's", "c.o", "c.o.p.q", "c.o.p.q[]"} <= set(tables)
    rel = {r["path"]: r for r in tables["c.s.m.rel"].collect()}
    assert rel["c/s/0/m/rel/0"]["value_text"] == "a" and rel["c/s/0/m/rel/2"]["value_text"] is None
    assert float(rel["c/s/0/m/rel/2"]["f_x"]) == 1.25 and rel["c/s/0/m/rel/2"]["parent_path"] == "c/s/0"
    every = {r["row_id"] for t in tables.values() for r in t.select("row_id").collect()}
    above = {r["parent_row_id"] for n, t in tables.items() if n != "c" for r in t.select("parent_row_id").collect()}
    assert above <= every


def test_table_queries_hold_the_values(spark, sf):
    from quernel.queries.corpus import QUERIES

    runs = spark.read.parquet(f"{sf}/audit_runs.parquet").collect()
    for query, column, field in (("p2_stages", "trace", "stages"), ("p2_events", "trace", "events"), ("p2_missing_relationships", "model_detail", "missing_relationships"), ("p2_interpretations", "model_detail", "interpretations")):
        want = {}
        for r in runs:
            v = load(r[column])
            if isinstance(v, dict):
                want |= {(r["run_id"], p): x for p, x in parts(through(v.get(field)), f"{column}/{field}")}
        df = QUERIES[query](spark, sf)
        rows = df.collect()
        key = "run_id" if query == "p2_stages" else "parent_id"
        assert len(rows) == len(want)
        for r in rows:
            x = want[r[key], r["path"]]
            if isinstance(x, dict):
                for f, y in x.items():
                    z = r[f"f_{f}"]
                    if y is None:
                        assert z in (None, "null")
                    else:
                        assert (json.loads(z) if isinstance(y, (dict, list)) else float(z) if isinstance(y, float) else z) == y
            else:
                assert r["value_text"] == str(x)


def test_flat_holds_every_list(spark, sf):
    from quernel.queries.corpus import QUERIES

    got = {(r["parent_table"], r["flat_table"], r["parent_id"], r["path"]) for r in QUERIES["p2_flat"](spark, sf).collect()}
    stages = set()
    for r in spark.read.parquet(f"{sf}/audit_runs.parquet").collect():
        v = load(r["trace"])
        for p, x in parts(through(v.get("stages")), "trace/stages") if isinstance(v, dict) else []:
            m = x.get("metadata") if isinstance(x, dict) else None
            if isinstance(m, dict):
                stages |= {(r["run_id"], q) for q, _ in parts(m.get("missing_relationships"), f"{p}/metadata/missing_relationships")}
    assert stages and {g[2:] for g in got if g[1] == "trace.stages.metadata.missing_relationships"} == stages
    assert {(t, i, p) for t, n, i, p in got if n in ("trace.stages", "trace.events", "model_detail.missing_relationships", "model_detail.interpretations", "cards", "cards.rows")} == brute(spark, sf)


def test_records_are_told_apart(spark):
    """Repeated rows are one record; other texts under an id, and rows without an id, are records of their own."""
    from quernel.operators.nested import records

    rows = [("a", "[1]"), ("a", "[1]"), ("b", "[1,2]"), ("b", "[3]"), (None, "[4]"), (None, "[5,6]"), (None, "[4]"), ("c", None), ("c", None)]
    df = spark.createDataFrame([(*r, "x", "y", i) for i, r in enumerate(rows)], "id string, text string, rec string, at string, n int")
    found = records(df, "id", ["text"])
    t = flatten(found, "id", F.col("text"), "c", "c", rec="rec")["c"].collect()
    assert sorted((r["parent_id"] or "", r["path"], r["value_text"]) for r in t) == [("", "c/0", "4"), ("", "c/0", "4"), ("", "c/0", "5"), ("", "c/1", "6"), ("a", "c/0", "1"), ("b", "c/0", "1"), ("b", "c/0", "3"), ("b", "c/1", "2")]
    assert len({r["row_id"] for r in t}) == len(t)
    again = flatten(records(df, "id", ["text"]), "id", F.col("text"), "c", "c", rec="rec")["c"].collect()
    assert {r["row_id"] for r in again if r["parent_id"]} == {r["row_id"] for r in t if r["parent_id"]}


def test_many_repeats_are_joined_by_shuffle(spark, monkeypatch):
    from quernel.operators import nested

    monkeypatch.setattr(nested, "BROADCAST_REPEATS", 2)
    df = spark.createDataFrame([(str(i % 40), f"[{i % 40}]") for i in range(100)], "id string, text string")
    assert nested.records(df, "id", ["text"]).count() == 40


def test_encoded_to_any_depth(spark):
    rows, text = [], "[1,2]"
    for depth in range(9):
        rows.append((str(depth), text))
        text = json.dumps(text)
    df = spark.createDataFrame([*rows, ("word", json.dumps(json.dumps("no json")))], "id string, text string")
    got = {r[0]: r[1] for r in df.select("id", F.size(element_paths(decoded(F.col("text")), "c"))).collect()}
    assert got == {str(d): 2 for d in range(9)} | {"word": 0}


def test_the_record_of_mixed_shapes(spark):
    """One record in another shape takes no table away."""
    rows = ['[{"o":{"inner":[1,2,3]},"l":[{"m":[{"z":1}]}],"aa":[[1,2],[3]]}]', '[{"l":{"k":1}}]']
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(rows)], "id string, text string")
    tables = flatten(df, "id", decoded(F.col("text")), "c", "c")
    counts = {n: t.count() for n, t in tables.items()}
    assert counts == {"c": 2, "c.o.inner": 3, "c.l": 1, "c.l.m": 1, "c.aa": 2, "c.aa[]": 3}
