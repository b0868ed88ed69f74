import random

from quernel.llm.canonical import question_key, statement_key
from quernel.llm.duplicates import members, representatives


def brute(rows):
    groups = {}
    for rid, question, sql in set(rows):
        for field, key in (("question", question_key(question)), ("sql", statement_key(sql))):
            if key is not None and rid is not None:
                groups.setdefault((field, key), set()).add(rid)
    return {(f, r, min(ids)) for (f, _), ids in groups.items() for r in ids}


def test_equals_brute_force(spark):
    rnd = random.Random(5)
    rows = [(f"r{i:04d}", rnd.choice(["Hot one?", "hot  ONE", f"q {rnd.randint(0, 60)}", f"Q, {rnd.randint(0, 60)}!", None, ""]), rnd.choice(["select a, b from t", "SELECT b, a FROM t;", None, f"select {rnd.randint(0, 9)}"])) for i in range(900)]
    rows += rows[:40] + [(None, "hot one", None)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "run string, question string, sql string").repartition(7)
    fields = {"question": "question", "sql": "statement"}
    got = [tuple(r) for r in members(df, "run", fields).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    counts = {(r["field"], r["first_id"]): r["n_copies"] for r in representatives(df, "run", fields).collect()}
    want = {}
    for f, _, first in brute(rows):
        want[f, first] = want.get((f, first), 0) + 1
    assert counts == want


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "id string, key string, field string")
    assert members(df, "id", {"key": "question", "field": "question"}).count() == 0
    df = spark.createDataFrame([("1", "a", "b"), ("2", "A", "c"), ("3", "d", "B!")], "id string, key string, field string")
    got = sorted(map(tuple, members(df, "id", {"key": "question", "field": "question"}).collect()))
    assert got == [("field", "1", "1"), ("field", "2", "2"), ("field", "3", "1"), ("key", "1", "1"), ("key", "2", "1"), ("key", "3", "3")]


def test_equal_hashes_stay_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quernel.llm import duplicates as D

    monkeypatch.setattr(D.F, "xxhash64", lambda *c: F.lit(7).cast("long"))  # every key has one hash, over all partitions
    rnd = random.Random(9)
    rows = [(f"r{i:04d}", f"q {rnd.randint(0, 9)}", None) for i in range(600)]
    df = spark.createDataFrame(rows, "run string, question string, sql string").repartition(5)
    assert {tuple(r) for r in members(df, "run", {"question": "question"}).collect()} == {x for x in brute(rows) if x[0] == "question"}
