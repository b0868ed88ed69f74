import pytest
from pyspark.sql import functions as F

from quernel.operators import profile, relate, report, results
from quernel.catalog import STAR, Relationship
from quernel.queries.relational import TABLES
from quernel.sources import register_tables

ROWS = [("a", "x,y", "A-1"), ("a", " ", "B-22"), (None, "p,q", "C-3"), ("b", "", None), ("b", None, "x"), ("b", "m,n", "7")]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "kind string, tags string, code string")


def test_shares(df):
    got = {r["column"]: (r["n"], r["null_share"], r["blank_share"]) for r in profile.shares(df, df.columns).collect()}
    assert got == {"kind": (6, 0.17, 0.0), "tags": (6, 0.17, 0.33), "code": (6, 0.17, 0.0)}


def test_domains(df, spark):
    got = {r["column"]: (r["complete"], r["values"]) for r in profile.domains(df, ["kind"]).collect()}
    assert got == {"kind": (True, "a|b")}
    many = spark.range(40).select(F.col("id").cast("string").alias("k"))
    assert profile.domains(many, ["k"]).head()["complete"] is False
    assert profile.domains(df.where("false"), ["kind"]).count() == 0


def test_patterns_and_separators(df):
    assert [(r["pattern"], r["n"]) for r in profile.patterns(df, ["code"]).orderBy("pattern").collect()] == [("9", 1), ("A-9", 1), ("B-99", 1)]
    assert [(r["column"], r["separator"], r["share"]) for r in profile.separators(df, df.columns).collect()] == [("tags", ",", 0.6)]


def test_keys_and_rates(df, spark):
    u = {r["column"]: r["is_unique"] for r in profile.unique_columns(df).collect()}
    assert u == {"kind": False, "tags": False, "code": False}
    assert profile.has_duplicates(df, "kind") and not profile.has_duplicates(df, "code")
    t = spark.createDataFrame([("a",), ("a",), ("z",)], "k string")
    assert tuple(profile.match_rate(df, "kind", t, "k").head()) == (5, 2, 0.4)


def test_declarations(spark, sf):
    register_tables(spark, sf, TABLES)
    bare = STAR.without_links()
    check = lambda t, *r: relate.check_declaration(spark, bare, t, Relationship(*r))
    assert check("orders", "o_custkey", "customer", "c_custkey") is None
    assert check("orders", "o_nothing", "customer", "c_custkey") == "NOT_FOUND"
    assert check("orders", "o_orderkey", "orders", "o_orderkey") == "SELF"
    assert check("orders", "o_orderstatus", "customer", "c_custkey") == "INCOMPATIBLE_TYPES"
    assert check("customer", "c_custkey", "orders", "o_custkey") == "TARGET_NOT_UNIQUE"
    assert relate.check_declaration(spark, STAR, "orders", Relationship("o_custkey", "customer", "c_custkey")) == "DUPLICATE"
    found = {(c.table, c.column, c.target) for c in relate.verified(spark, relate.candidates(bare, {t.name: set(t.key) for t in bare.tables if len(t.key) == 1}))}
    assert {(t.name, r.column, r.target) for t in STAR.tables for r in t.relationships} == found
    merged, stale = relate.merge_declared(bare, {"orders": [Relationship("o_custkey", "customer", "c_custkey"), Relationship("gone", "customer", "c_custkey")], "nowhere": [Relationship("a", "customer", "c_custkey")]})
    assert len(merged.table("orders").relationships) == 1 and len(stale) == 2


def test_results(spark):
    df = spark.createDataFrame([(50.0, 120.0, 1), (-1.0, None, 2)], "share_percent double, pct_change double, ratio int")
    assert {r["column"]: r["n_outside"] for r in results.percent_out_of_range(df).collect()} == {"share_percent": 1, "pct_change": 1}
    assert results.percent_out_of_range(df.select("ratio")).count() == 0
    assert results.looks_empty([]) and results.looks_empty([{"a": None, "b": 0}]) and not results.looks_empty([{"a": 1}])
    a = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y")], "i int, s string")
    b = spark.createDataFrame([(1, "x"), (None, "y"), (2, "z")], "j int, t string")
    assert tuple(results.same_reading(a, b).head()) == (True, 1, 1) and tuple(results.same_reading(a, a).head()) == (True, 0, 0)
    assert results.same_reading(a, b.select("j")).head()["same_width"] is False
    assert [tuple(r) for r in results.probe_report(a).orderBy("column").collect()] == [("i", 3, 1, 1), ("s", 3, 2, 0)]
    assert results.out_of_order([{"v": 9.0}, {"v": None}, {"v": 5.0}, {"v": 7.0}], "v") == 1 and results.out_of_order([], "v") == 0


def test_report(spark, tmp_path):
    df = spark.createDataFrame([(c, s, float(i + 1)) for i, s in enumerate("abcdefgh") for c in "xy"] + [("x", None, 1.0)], "cat string, ser string, v double")
    got = report.with_rest(df, "cat", "ser", "v", 6).collect()
    assert sum(r["total"] for r in got) == 2 * 36 + 1 and {r["series"] for r in got} == {"c", "d", "e", "f", "g", "h", "Other (3)"}
    assert len(report.pivot(df, "cat", "ser", "v").columns) == 8
    assert {r["label"]: r["total"] for r in report.slices(df, "ser", "v", 2).collect()} == {"h": 16.0, "g": 14.0, "Other": 43.0}
    assert tuple(report.compared(spark.createDataFrame([(2, 6.0), (1, 4.0)], "y int, v double"), "y", "v").head()) == (6.0, 4.0, 2.0, 50.0)
    cells = ["=1+1", "+5", "-3.5", "@x", "plain", "\tx", "-a", ""]
    safe = [r[0] for r in spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").orderBy("i").select(report.csv_safe(F.col("c"))).collect()]
    assert safe == ["'=1+1", "+5", "-3.5", "'@x", "plain", "'\tx", "'-a", ""]
    report.write_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == df.count()
    assert report.suggested_chart(df) == "bar" and report.suggested_chart(df.select("v")) == "number"


def test_snapshots(spark):
    import datetime as dt

    rows = [("r" if i % 3 else "s", dt.datetime(2025, 1, 1) + dt.timedelta(hours=i), f"n{i:03d}") for i in range(90)]
    df = spark.createDataFrame(rows + rows[:9], "report string, at timestamp, id string")
    got = {r["id"] for r in report.latest_snapshots(df, "report", "at", "id", 4).collect()}
    want = {x[2] for r in "rs" for x in sorted((x for x in rows if x[0] == r), key=lambda x: x[1])[-4:]}
    assert got == want


def test_personal_columns_are_left_out(spark):
    df = spark.createDataFrame([], "id string, n_name string, first_name string, LastName string, e_mail string, city string, note string, phone2 string, api_token string, size int")
    assert profile.eligible(df, {"id"}) == ["n_name", "city", "note"]


def test_small_shares_count_as_none(spark):
    df = spark.range(400).select(F.when(F.col("id") > 1, "x").alias("a"), F.when(F.col("id") > 9, "x").otherwise(" ").alias("b"))
    got = {r["column"]: (r["null_share"], r["blank_share"]) for r in profile.shares(df, ["a", "b"]).collect()}
    assert got == {"a": (0.0, 0.0), "b": (0.0, 0.03)}


def test_format_examples(spark):
    df = spark.range(101).select(F.format_string("%03d-1", "id").alias("code"), F.format_string("a%d", "id").alias("word"), (F.col("id") % 3).cast("string").alias("few"), F.lit(None).cast("string").alias("none"))
    got = {r["column"]: r["examples"] for r in profile.format_examples(df.unionByName(df), df.columns).collect()}
    assert got == {"code": "000-1|050-1|100-1"}
    assert profile.format_examples(df.where("false"), df.columns).count() == 0


def test_natural_order_and_categories(spark):
    df = spark.createDataFrame([(f"Brand#{i}", "s", 1.0) for i in (10, 9, 2, 100)] + [("brand#9", "s", 1.0), (None, "s", 1.0)], "l string, s string, v double")
    assert [r[0] for r in report.arranged(df, "l", "v", "label").collect()] == ["Brand#2", "Brand#9", "brand#9", "Brand#10", "Brand#100", None]
    many = spark.range(90).select(F.format_string("c%d", "id").alias("c"), F.lit("s").alias("s"), F.lit(1.0).alias("v"))
    wide = report.pivot(many, "c", "s", "v").collect()
    assert len(wide) == report.MOST_CATEGORIES and {r["category"] for r in wide} == {f"c{i}" for i in range(60)}
