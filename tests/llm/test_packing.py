import random

import pytest

from quernel.llm.packing import BestFit, fill, pack


def test_best_fit_choices():
    b = BestFit(10, 2)
    assert b.place(6) == 0 and b.place(7) == 1
    assert b.place(3) == 1  # the fuller bin that fits
    assert b.place(4) == 0
    assert b.place(5) == 2 and b.place(8) == 3
    assert b.place(9) == 4  # the fullest, 3, closed
    assert b.still_open() == {2, 4}


@pytest.mark.parametrize(("capacity", "open_bins"), [(100, 4), (100, 256), (7, 1)])
def test_rules(spark, capacity, open_bins):
    rnd = random.Random(capacity)
    sizes = [rnd.choice([0, 1, rnd.randint(1, 60), rnd.randint(1, 350)]) for _ in range(1500)]
    df = spark.createDataFrame([(i, s, "c") for i, s in enumerate(sizes)], "doc long, n int, container string").repartition(6)
    rows = pack(df, "doc", "n", capacity, open_bins).collect()
    load, pieces = {}, {}
    for r in rows:
        load[r["container"]] = load.get(r["container"], 0) + r["size"]
        pieces.setdefault(r["item"], []).append((r["piece"], r["start"], r["size"]))
    assert max(load.values()) <= capacity
    assert sorted(pieces) == list(range(1500))
    for i, s in enumerate(sizes):
        p = sorted(pieces[i])
        assert sum(x[2] for x in p) == s and [x[0] for x in p] == list(range(len(p)))
        assert [x[1] for x in p] == [sum(y[2] for y in p[:k]) for k in range(len(p))]
        assert s > capacity or len(p) == 1
    if open_bins > 1:
        assert sum(load.values()) / (len(load) * capacity) > 0.93


def test_edges(spark):
    df = spark.createDataFrame([(1, None), (1, 5), (None, 3), (2, 30)], "doc long, n int")
    rows = pack(df, "doc", "n", 10).collect()
    assert sorted((r["item"] or -1, r["piece"], r["size"]) for r in rows) == [(-1, 0, 3), (1, 0, 0), (1, 0, 5), (2, 0, 10), (2, 1, 10), (2, 2, 10)]
    assert pack(df.where("false"), "doc", "n", 10).count() == 0
    f = fill(pack(df, "doc", "n", 10), 10).head()
    assert (f["n_containers"], f["n_tokens"], f["least"]) == (4, 38, 4)
    with pytest.raises(ValueError):
        pack(df, "doc", "n", 0)


def test_many_empty_items(spark):
    df = spark.range(50_000).selectExpr("id as doc", "if(id % 1000 = 0, 7, 0) as n")
    for some, n_items, total in ((df, 50_000, 350), (df.where("n = 0"), 49_950, 0)):
        rows = pack(some, "doc", "n", 10)
        assert rows.count() == n_items and rows.where("container is null").count() == 0
        f = fill(rows, 10).head()
        assert f["n_tokens"] == total and f["n_containers"] <= 50 + 64


def test_ids_come_back_as_they_are(spark):
    some = [2**60 + 1, None, 2**60 + 3, -5]
    df = spark.createDataFrame([(i, 4) for i in some], "doc long, n int").coalesce(1)
    rows = pack(df, "doc", "n", 10).collect()
    assert sorted((r["item"] for r in rows), key=str) == sorted(some, key=str)
    assert rows[0]["container"] is not None and len({r["container"] for r in rows}) == 2


def test_bins_left_open_are_packed_by_levels(spark, monkeypatch):
    """Several tasks pack what partitions left open, with as many open bins as the first level, until one is left."""
    from quernel.llm import packing

    seen, run = [], packing._pack
    monkeypatch.setattr(packing, "BINS_PER_TASK", 8)
    monkeypatch.setattr(packing, "_pack", lambda c, o, level=0: (seen.append((level, o)), run(c, o, level))[1])
    rnd = random.Random(4)
    sizes = [rnd.randint(1, 70) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc long, n int")
    adaptive, parts = "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions"
    before = {k: spark.conf.get(k) for k in (adaptive, parts)}
    try:
        spark.conf.set(adaptive, "false")
        spark.conf.set(parts, "8")
        rows = pack(df, "doc", "n", 100, 16).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    load = {}
    for r in rows:
        load[r["container"]] = load.get(r["container"], 0) + r["size"]
    assert sorted(r["item"] for r in rows) == list(range(4000)) and max(load.values()) <= 100 and sum(load.values()) == sum(sizes)
    assert {o for _, o in seen} == {16} and max(level for level, _ in seen) > 1
    assert sum(sizes) / (100 * len(load)) > 0.95
