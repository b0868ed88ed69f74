"""Deeply nested JSON to flat tables that keep their parent links.

Texts are parsed once into Spark's VARIANT, on the JVM. Each *place* (a field
that holds a list) is exploded into a child table carrying the parent's key,
the element's path and its ordinal; typed columns come from the schema merged
over all elements (``schema_of_variant_agg``), and every list below, at
whatever depth of objects, becomes a child table of its own, and so on down.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.workspace import materialise, spread

#: Repeated records up to this number are broadcast to drop them; beyond it they are joined by shuffle.
BROADCAST_REPEATS = 200_000


def _one_value(text: Column) -> Column:
    """The variant of a text that is one complete JSON value; null for any other.

    The parser stops at the end of the first value; inside brackets, whatever
    follows makes the text invalid or a second element.
    """
    held = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(F.try_variant_get(held, "$[1]", "variant").isNull(), F.try_variant_get(held, "$[0]", "variant"))


def _plain(text: Column) -> Column:
    """A text that is a JSON string, read through to the text that isn't one.

    Encoding a text again at least doubles its quotes and backslashes, so one of
    n characters is encoded fewer than log2(n) + 2 times.
    """
    encoded = F.ltrim(text).startswith('"')
    most = F.ceil(F.log2(F.length(text))).cast("int") + 2
    inner = lambda t: F.when(F.ltrim(t).startswith('"'), F.try_variant_get(_one_value(t), "$", "string")).otherwise(t)
    return F.when(encoded, F.reduce(F.sequence(F.lit(1), most), text, lambda t, _: inner(t))).otherwise(text)


def decoded(text: Column) -> Column:
    """The variant of a JSON text; a text encoded several times is read through.

    Null for a null text and for text that is not one complete JSON value.
    """
    return _one_value(_plain(text))


def records(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each record once: id, rec and the decoded columns, kept so that texts are parsed once.

    Rows with one id and equal texts are one record that arrived repeatedly;
    with unlike texts they are records of their own, as are all rows without an
    id. ``rec`` tells records apart: the same in every run, but for those
    without an id. Only ids and hashes are shuffled, and a frame that comes in few
    parts.
    """
    at = F.monotonically_increasing_id()
    texts = F.md5(F.concat(*(F.coalesce(F.concat(F.length(F.col(f"`{c}`")).cast("string"), F.lit(":"), F.col(f"`{c}`")), F.lit("-")) for c in columns)).cast("binary"))
    few = spread(df.select(F.col(f"`{key}`"), *(F.col(f"`{c}`") for c in columns)))
    rows = few.select(F.col(f"`{key}`").cast("string").alias("id"), at.alias("at"), texts.alias("texts"), *(decoded(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(columns)))
    rec = F.md5(F.concat(F.coalesce(F.concat(F.lit("="), F.col("id")), F.concat(F.lit("#"), F.col("at").cast("string"))), F.lit("\n"), F.col("texts")).cast("binary"))
    rows = materialise(rows.select("id", "at", rec.alias("rec"), *(F.col(f"c{i}").alias(c) for i, c in enumerate(columns))), "records")
    again = rows.select("rec", "at").groupBy(F.col("rec").alias("again")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = materialise(again, "repeats")
    if again.limit(BROADCAST_REPEATS + 1).count() <= BROADCAST_REPEATS:
        again = F.broadcast(again)
    kept = rows.join(again, F.col("rec") == F.col("again"), "left").where(F.col("first").isNull() | (F.col("at") == F.col("first")))
    return kept.select("id", "rec", *(f"`{c}`" for c in columns))


def _as_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _is_null(v: Column) -> Column:
    return v.isNull() | F.is_variant_null(v)


def unwrapped(v: Column) -> Column:
    """A variant that is itself a string holding JSON is read through."""
    inner = decoded(F.try_variant_get(v, "$", "string"))
    is_text = _as_object(v).isNull() & F.try_variant_get(v, "$", "array<variant>").isNull()
    return F.when(is_text, F.coalesce(inner, v)).otherwise(v)


def elements(v: Column) -> Column:
    """array<struct<key, value>> of the elements at a place.

    An array gives its elements by position from 0; null elements are left out
    but keep their position. An object whose values are all objects gives its
    values by key (an empty one gives none). Any other object is one element
    at 0. Null, a scalar or nothing there gives an empty array.
    """
    listed = F.try_variant_get(v, "$", "array<variant>")
    keyed = _as_object(v)
    positions = F.transform(listed, lambda x, i: F.struct(i.cast("string").alias("key"), x.alias("value")))
    entries = F.transform(F.map_entries(keyed), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    single = F.array(F.struct(F.lit("0").alias("key"), v.alias("value")))
    empty = F.filter(single, lambda e: F.lit(False))
    return (
        F.when(listed.isNotNull(), F.filter(positions, lambda e: ~_is_null(e["value"])))
        .when(keyed.isNull(), empty)
        .when(F.forall(F.map_values(keyed), lambda x: _as_object(x).isNotNull()), entries)
        .otherwise(single)
    )


def place(v: Column, field: str) -> Column:
    """What stands at one field of a variant object, read through if encoded."""
    return _typed(v, field, "variant")


def _typed(v: Column, field: str, kind: str) -> Column:
    if re.search(r"['?\\]", field) or not field:  # no path can name it
        return F.try_variant_get(_as_object(v)[field], "$", kind)
    return F.try_variant_get(v, f"$['{field}']", kind)


def element_paths(v: Column, prefix: str | Column) -> Column:
    """array<string> of the paths of the elements at a place."""
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.transform(elements(v), lambda e: F.concat(head, F.lit("/"), e["key"]))


def child_table(df: DataFrame, key: str, v: Column, path: str | Column, rec: str | None = None) -> DataFrame:
    """One row for each element at a place: parent_id, rec, path, ordinal, value.

    ``rec`` names the column that tells records apart, as a rule the key. ``ordinal`` is the element's position among the non-null elements where it
    stands by key, else its position in the array.
    """
    head = F.lit(path) if isinstance(path, str) else path
    return (
        df.select(F.col(key).alias("parent_id"), _rec(key, rec), head.alias("head"), F.posexplode(elements(v)).alias("at", "e"))
        .select(
            "parent_id",
            "rec",
            F.concat("head", F.lit("/"), "e.key").alias("path"),
            F.coalesce(F.expr("try_cast(e.key as int)"), F.col("at")).alias("ordinal"),
            F.col("e.value").alias("value"),
        )
    )


def merged_schema(df: DataFrame, column: str = "value") -> str:
    """The schema merged over all variants of a column, as DDL of variants."""
    row = df.agg(F.schema_of_variant_agg(column).alias("s")).head()
    return (row and row["s"]) or "VOID"


def object_fields(schema: str) -> dict[str, str]:
    """Field names and merged types of ``OBJECT<a: BIGINT, b: ARRAY<...>>``; {} for any other type."""
    m = re.fullmatch(r"OBJECT<(.*)>", schema.strip(), re.S)
    out: dict[str, str] = {}
    if not m:
        return out
    depth, start, quoted, parts = 0, 0, False, []
    text = m[1]
    for i, ch in enumerate(text):
        if ch == "`":
            quoted = not quoted
        elif not quoted:
            depth += (ch in "<(") - (ch in ">)")
            if ch == "," and depth == 0:
                parts.append(text[start:i])
                start = i + 1
    for p in [*parts, text[start:]]:
        if ":" in p:
            name, kind = (re.match(r"\s*`((?:[^`]|``)*)`\s*:(.*)", p, re.S) or re.match(r"\s*([^:]*?)\s*:(.*)", p, re.S)).groups()
            out[name.replace("``", "`")] = kind.strip()
    return out


_SCALARS = {"BIGINT": "bigint", "DOUBLE": "double", "STRING": "string", "BOOLEAN": "boolean"}


def _rec(key: str, rec: str | None) -> Column:
    return (F.col(rec) if rec else F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))).alias("rec")


def row_id(path: Column) -> Column:
    """The surrogate key of the row at a path of a record."""
    return F.md5(F.concat(F.col("rec"), F.lit("\n"), path).cast("binary"))


def flatten(
    df: DataFrame, key: str, v: Column, path: str, name: str, declared: dict[str, str] | None = None, rec: str | None = None
) -> dict[str, DataFrame]:
    """All flat tables below a place, keyed by their dotted name; each is written once and read from there.

    Each table has row_id (its key), parent_row_id (the key of the element
    above, or of the column), parent_id (the record), parent_path, path,
    ordinal and a typed column for each field of the merged schema, as
    ``f_<field>``; objects and mixed types stay variants there. Every list
    below becomes a table of its own, also below objects (``name.object.field``),
    in fields of mixed shapes and directly in lists (``name[]``), recursively.
    ``declared`` names places to be read as lists in whatever shape. ``rec``
    names a column that tells records apart where keys don't (see ``records``).
    Elements that are no objects stand in ``value_text``. No elements: a table
    without ``f_`` columns and without rows.
    """
    base = child_table(df, key, v, path, rec).withColumn("parent_path", F.lit(path))
    return _tables(materialise(base, "elements"), name, declared or {})


def flatten_record(
    df: DataFrame, key: str, v: Column, name: str, declared: dict[str, str] | None = None, rec: str | None = None
) -> dict[str, DataFrame]:
    """As ``flatten``, of columns that hold one object for each record: ``name`` is the table of these objects."""
    base = df.select(
        F.col(key).alias("parent_id"),
        _rec(key, rec),
        F.lit(name).alias("path"),
        F.lit(0).alias("ordinal"),
        v.alias("value"),
        F.lit(None).cast("string").alias("parent_path"),
    )
    return _tables(base.where(~_is_null(F.col("value"))), name, declared or {})


def _standing(at: tuple[str, ...], mixed: set[tuple[str, ...]]) -> Column:
    """What stands at a place within an element; where shapes are mixed, texts that hold JSON are read through."""
    if not at:
        return F.col("value")
    v = place(_standing(at[:-1], mixed), at[-1])
    return unwrapped(v) if at in mixed else v


def _shape(base: DataFrame, name: str, declared: dict[str, str]) -> tuple[dict[str, str], dict[tuple[str, ...], bool], set[tuple[str, ...]]]:
    """Of all elements: merged types by field, the places of lists (whether declared), and the places of mixed shapes.

    A merged type tells nothing of what is below mixed shapes; the objects that
    stand there are merged again on their own, level by level.
    """
    fields: dict[str, str] = {}
    lists: dict[tuple[str, ...], bool] = {}
    mixed: set[tuple[str, ...]] = set()
    todo: list[tuple[str, ...]] = []

    def walk(at: tuple[str, ...], kind: str) -> None:
        if at and declared.get(".".join([name, *at])) == "list":
            lists[at] = True
            mixed.add(at)
        elif kind.startswith("ARRAY<"):
            lists[at] = False
        elif kind.startswith("OBJECT<"):
            for f, k in object_fields(kind).items():
                if not at:
                    fields[f] = k
                walk((*at, f), k)
        elif kind == "VARIANT":
            mixed.add(at)
            todo.append(at)

    walk((), merged_schema(base))
    while todo:
        now = [*todo]
        todo.clear()
        held = base.select(*(_standing(at, mixed).alias(f"v{i}") for i, at in enumerate(now)))
        found = held.agg(
            *(F.schema_of_variant_agg(F.when(_as_object(F.col(f"v{i}")).isNotNull(), F.col(f"v{i}"))).alias(f"s{i}") for i in range(len(now))),
            *(F.max(F.try_variant_get(f"v{i}", "$[0]", "variant").isNotNull()).alias(f"a{i}") for i in range(len(now))),
        ).head()
        for i, at in enumerate(now):
            if found[f"a{i}"]:
                lists[at] = False
            walk(at, found[f"s{i}"] or "VOID")
    return fields, lists, mixed


def _column_names(fields: list[str]) -> list[str]:
    """``f_<field>``, numbered where fields differ in letter case only."""
    out: list[str] = []
    seen: set[str] = set()
    for f in fields:
        n, k = f"f_{f}", 1
        while n.lower() in seen:
            k += 1
            n = f"f_{f}_{k}"
        seen.add(n.lower())
        out.append(n)
    return out


def _tables(base: DataFrame, name: str, declared: dict[str, str]) -> dict[str, DataFrame]:
    fields, lists, mixed = _shape(base, name, declared)
    kept = [f for f in fields if (f,) not in lists or ((f,) in mixed and not lists[(f,)])]
    columns = [
        _typed(F.col("value"), f, _SCALARS.get(fields[f], fields[f].lower() if fields[f].startswith("DECIMAL") else "variant")).alias(n)
        for f, n in zip(kept, _column_names(kept), strict=True)
    ]
    text = F.try_variant_get("value", "$", "string")
    if fields:
        text = F.when(_as_object(F.col("value")).isNull(), text) if () in mixed else F.lit(None).cast("string")
    head = [row_id(F.col("path")).alias("row_id"), row_id(F.col("parent_path")).alias("parent_row_id"), "parent_id", "parent_path", "path", "ordinal"]
    out = {name: base.select(*head, text.alias("value_text"), *columns)}
    for at, told in lists.items():
        below = base.select("parent_id", "rec", F.col("path").alias("above"), _standing(at, mixed).alias("v"))
        found = elements(F.col("v"))
        if not told and at in mixed:  # objects at this place are no lists: what is below them has its own tables
            found = F.when(F.try_variant_get("v", "$[0]", "variant").isNotNull(), found)
        nested = (
            below.select("parent_id", "rec", "above", F.posexplode(found).alias("at", "e"))
            .select(
                "parent_id",
                "rec",
                F.concat("above", F.lit("".join(f"/{f}" for f in at) + "/"), "e.key").alias("path"),
                F.coalesce(F.expr("try_cast(e.key as int)"), F.col("at")).alias("ordinal"),
                F.col("e.value").alias("value"),
                F.col("above").alias("parent_path"),
            )
        )
        out |= _tables(materialise(nested, "elements"), ".".join([name, *at]) if at else f"{name}[]", declared)
    return out
