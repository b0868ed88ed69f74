import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.llm import digest as D


def test_cluster_keeps_weight_and_order():
    rng = np.random.default_rng(0)
    v = rng.lognormal(5, 3, 50_000)
    m, w = D.cluster(v, np.ones(len(v)), 200)
    assert len(m) <= 201 and w.sum() == len(v) and (np.diff(m) >= 0).all()
    assert np.isclose((m * w).sum(), v.sum())


@pytest.mark.parametrize("kind", ["lognormal", "ties", "two"])
def test_merged_error(kind):
    rng = np.random.default_rng(1)
    v = {"lognormal": rng.lognormal(2, 2, 40_000), "ties": rng.integers(0, 5, 40_000).astype(float), "two": np.concatenate([np.zeros(39_999), [1e9]])}[kind]
    parts = [D.cluster(p, np.ones(len(p)), 200) for p in np.array_split(v, 37)]
    m, w = D.cluster(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), 200)
    for q in (0.01, 0.5, 0.99):
        e = D.quantile(m, w, v.min(), v.max(), q)
        below, at_most = (v < e).mean(), (v <= e).mean()
        if kind == "lognormal":
            assert below - D.RANK_ERROR <= q <= at_most + D.RANK_ERROR


def test_percentiles_are_certified(spark):
    rng = np.random.default_rng(2)
    rows = [(("a", "b", None)[int(g)], int(d), float(x), "n") for g, d, x in zip(rng.integers(0, 3, 6000), rng.integers(0, 9, 6000), rng.lognormal(3, 2, 6000), strict=True)]
    rows += [("hot", 1, float(x), "n") for x in rng.integers(0, 3, 3000)] + [("one", 1, 7.0, "n")]
    df = spark.createDataFrame(rows, "k string, day int, v double, n string").repartition(5)
    got = D.percentiles(df, ["k"], "v", "day", compression=20).collect()
    assert len(got) == 5 * len(D.PERCENTILES)
    by = {}
    for k, _, x, _ in rows:
        by.setdefault(k, []).append(x)
    for r in got:
        v = np.array(by[r["k"]])
        assert r["n"] == len(v) and r["n_below"] == (v < r["estimate"]).sum() and r["n_equal"] == (v == r["estimate"]).sum()
        assert r["rank_error"] <= max(D.RANK_ERROR, 1 / len(v))


def test_days_combine(spark):
    df = spark.range(5000).select(F.lit("a").alias("k"), (F.col("id") % 7).alias("day"), F.col("id").cast("double").alias("v"))
    daily = D.merge_digests(D.partial_digests(df, ["k", "day"], "v", 200), ["k", "day"], 200)
    assert daily.count() == 7
    row = D.read_percentiles(D.merge_digests(daily, ["k"], 200), ["k"], (0.5,)).head()
    assert row["n"] == 5000 and abs(row["estimates"][0] - 2500) < 25


def test_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(D, "FAN_IN", 3)
    df = spark.range(9000).select((F.col("id") % 2).cast("string").alias("k"), F.col("id").cast("double").alias("v")).repartition(11)
    got = {r["k"]: (r["n"], sum(r["weights"]), r["low"], r["high"], len(r["means"])) for r in D.digests(df, ["k"], "v").collect()}
    assert {k: v[:4] for k, v in got.items()} == {"0": (4500, 4500.0, 0.0, 8998.0), "1": (4500, 4500.0, 1.0, 8999.0)}
    assert all(v[4] <= D.COMPRESSION + 1 for v in got.values())
    r = D.percentiles(df.withColumn("day", F.lit(1)), ["k"], "v", "day", (0.5,)).collect()
    assert all(x["rank_error"] <= D.RANK_ERROR for x in r)


def test_impossible_values_and_empty(spark):
    rows = [(None,), (float("nan"),), (float("inf"),), (-1.0,), (0.0,), (2.0,)]
    df = spark.createDataFrame(rows, "v double")
    assert [r[0] for r in D.possible_values(df, "v", above=0.0).collect()] == [2.0]
    assert [r[0] for r in D.possible_values(df, "v").collect()] == [-1.0, 0.0, 2.0]
    empty = spark.createDataFrame([], "k string, day int, v double")
    assert D.percentiles(empty, ["k"], "v", "day").count() == 0


def test_what_digests_cannot_bound_is_read_off_in_order(spark, monkeypatch):
    """A few atoms far apart: an interpolated value has no rank there; a group with ties and nulls as key."""
    seen, run = [], D.exact
    monkeypatch.setattr(D, "AGAIN", 0)
    monkeypatch.setattr(D, "exact", lambda *a: (seen.append(1), run(*a))[1])
    rng = np.random.default_rng(5)
    rows = [("a", 1, float(x)) for x in rng.integers(0, 4, 5000) ** 9] + [(None, 1, float(x)) for x in rng.lognormal(1, 4, 3000)] + [("b", 2, 3.0)]
    df = spark.createDataFrame(rows, "k string, day int, v double").repartition(6)
    got = D.percentiles(df, ["k"], "v", "day", compression=2).collect()
    assert seen and len(got) == 3 * len(D.PERCENTILES)
    by = {}
    for k, _, x in rows:
        by.setdefault(k, []).append(x)
    for r in got + run(df, ["k"], "v").collect():
        v = np.sort(by[r["k"]])
        assert r["n"] == len(v) and r["n_below"] == (v < r["estimate"]).sum() and r["n_equal"] == (v == r["estimate"]).sum()
        off = max(r["n_below"] - r["percentile"] * len(v), r["percentile"] * len(v) - r["n_below"] - r["n_equal"], 0) / len(v)
        assert off <= max(D.RANK_ERROR, 1 / len(v))
