import datetime as dt
import random

import pytest

from quernel.operators.sessions import sessionize

T0 = dt.datetime(2025, 12, 1)


def brute(rows, gap):
    by = {}
    for u, t, i in {(u and u.lower(), t, i) for u, t, i in rows if t is not None}:
        by.setdefault(u, []).append((t, i))
    out = []
    for u, events in by.items():
        events.sort()
        cur = [events[0]]
        for e in events[1:]:
            if (e[0] - cur[-1][0]).total_seconds() > gap * 60:
                out.append((u, cur))
                cur = []
            cur.append(e)
        out.append((u, cur))
    return sorted((u or "", c[0][0], c[-1][0], len(c), c[0][1], c[-1][1]) for u, c in out)


@pytest.mark.parametrize("chunk", [0.5, 15, 30])
def test_equals_brute_force(spark, chunk):
    rnd = random.Random(chunk)
    rows = [(rnd.choice(["Ann", "ann", "BOB", None]), T0 + dt.timedelta(seconds=rnd.choice([rnd.randint(0, 400_000), 1800 * rnd.randint(0, 200)])), f"r{i:04d}") for i in range(500)]
    rows += rows[:50] + [("x", None, "r")]
    df = spark.createDataFrame(rows, "user string, ts timestamp_ntz, n string")
    got = sessionize(df, "user", "ts", "n", 30, chunk).collect()
    assert sorted((r["user"] or "", r["session_start"], r["session_end"], r["n_events"], r["first_event"], r["last_event"]) for r in got) == brute(rows, 30)


def test_exact_gap_and_ties(spark):
    rows = [("a", T0, "2"), ("a", T0, "1"), ("a", T0 + dt.timedelta(minutes=30), "3"), ("a", T0 + dt.timedelta(minutes=60, microseconds=1), "4")]
    got = sessionize(spark.createDataFrame(rows, "k string, t timestamp_ntz, u string"), "k", "t", "u").orderBy("session_start").collect()
    assert [(r["first_event"], r["last_event"], r["n_events"], r["duration_s"]) for r in got] == [("1", "3", 3, 1800.0), ("4", "4", 1, 0.0)]


def test_empty_and_bad_chunk(spark):
    df = spark.createDataFrame([], "a string, t timestamp_ntz, i string")
    assert sessionize(df, "a", "t", "i").count() == 0
    with pytest.raises(ValueError):
        sessionize(df, "a", "t", "i", 10, 15)
