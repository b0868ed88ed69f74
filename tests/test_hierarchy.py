"""Hierarchies against plain pointer chasing, with partitions far smaller than the trees."""

import random

import pytest
from pyspark.sql import functions as F

from quernel.operators import hierarchy as H


def brute(links):
    out = {}
    nodes = set(links)
    for n in links:
        trail, x = [n], links[n]
        while x in nodes and x not in trail and links.get(x) in (nodes | {None}):
            trail.append(x)
            x = links[x]
        if x is None or x not in nodes:
            out[n] = (trail[-1], len(trail) - 1, False, trail[::-1])
        else:
            loop = trail[trail.index(x) :]
            out[n] = (min(loop), -1, True, None)
    return out


def graph(seed, n, span):
    rnd = random.Random(seed)
    links = {f"n{i:05d}": (f"n{max(0, i - rnd.randint(1, span)):05d}" if i and rnd.random() < 0.9 else None) for i in range(n)}
    for _ in range(4):  # loops of several lengths, with trees below them
        ring = rnd.sample(sorted(links), rnd.choice([1, 2, 7, 40]))
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            links[a] = b
    return links


@pytest.mark.parametrize(("seed", "span", "per_task", "shrink"), [(1, 3, 50, 0.7), (2, 400, 40, 0.7), (3, 5, 60, 0.0), (4, 2, 10_000, 0.7), (5, 1, 90, 0.0)])
def test_equals_pointer_chasing(spark, monkeypatch, seed, span, per_task, shrink):
    monkeypatch.setattr(H, "SHRINK", shrink)
    links = graph(seed, 400, span)
    df = spark.createDataFrame([(k, v) for k, v in links.items()], "id string, up string")
    got = H.hierarchy(df, "id", ["up"], F.substring("id", 2, 9).cast("long"), True, per_task)
    assert {r["node"]: (r["root_id"], r["depth"], r["in_loop"], r["path"]) for r in got.collect()} == brute(links)


def test_one_chain_in_random_order_and_a_star(spark):
    """Without locality every level still shrinks, and a parent of most nodes doesn't gather its children."""
    rnd = random.Random(7)
    ids = [f"x{i:04d}" for i in rnd.sample(range(600), 600)]
    links = dict(zip(ids[1:], ids, strict=False)) | {ids[0]: None}
    for i in range(300):
        links |= {f"s{i}": ids[40], f"t{i}": f"s{i}"}
    df = spark.createDataFrame(list(links.items()), "id string, up string")
    got = H.hierarchy(df, "id", ["up"], None, False, 100)
    assert {r["node"]: (r["root_id"], r["depth"]) for r in got.collect()} == {k: v[:2] for k, v in brute(links).items()}


def test_all_cores_take_part_and_levels_merge(spark, monkeypatch):
    """Some thousands of links are cut into several parts, by the same way as billions."""
    seen = []
    placed = H._placed
    monkeypatch.setattr(H, "_placed", lambda links, parts, *a: seen.append(parts) or placed(links, parts, *a))
    n = 9_000
    df = spark.range(n).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") > 2, F.floor(F.col("id") * 0.7)).cast("string").alias("up"))
    got = H.hierarchy(df, "id", ["up"], F.col("id").cast("long")).groupBy("root_id").count().count()
    assert seen[0] > 1 and len(seen) > 1 and got == 3


def test_dirty_pointers(spark):
    rows = [
        ("A ", None, None, 1), ("a", None, None, 1), ("b", " A\n", None, 1), ("c", " ", "B", 1), ("d", "", None, 1),
        ("e", "gone", "b", 1), ("f", "f", None, 1), ("g", "F", "b", 1), (None, "a", None, 1), ("h", None, "\tc ", 1),
    ]
    df = spark.createDataFrame(rows, "run string, follow string, edited string, node int")
    got = {r["node"]: (r["parent_id"], r["root_id"], r["depth"]) for r in H.hierarchy(df, "run", ["follow", "edited"]).collect()}
    assert got == {
        "a": (None, "a", 0), "b": ("a", "a", 1), "c": ("b", "a", 2), "d": (None, "d", 0),
        "e": (None, "e", 0), "f": ("f", "f", -1), "g": ("f", "f", -1), "h": ("c", "a", 3),
    }


def test_empty(spark):
    df = spark.createDataFrame([], "id string, up string")
    assert H.hierarchy(df, "id", ["up"], with_paths=True).count() == 0


def test_descendants(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "x")], "id string, up string")
    got = H.descendants(H.hierarchy(df, "id", ["up"], with_paths=True))
    assert sorted(map(tuple, got.collect())) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]


def chased(links):
    """(ancestor, node, distance) of every node, up until the way repeats."""
    out = set()
    for n in links:
        x, steps, seen = links[n], 1, {n}
        while x is not None and x in links and x not in seen:
            out.add((x, n, steps))
            seen.add(x)
            x, steps = links[x], steps + 1
    return out


def on_loop(links, n):
    x = links[n]
    for _ in range(len(links)):
        if x == n:
            return True
        if x is None:
            return False
        x = links[x]
    return False


@pytest.mark.parametrize(("seed", "span", "per_task", "shrink"), [(1, 3, 50, 0.7), (3, 5, 60, 0.0), (4, 2, 10_000, 0.7)])
def test_later_nodes_on_and_below_loops(spark, monkeypatch, seed, span, per_task, shrink):
    monkeypatch.setattr(H, "SHRINK", shrink)
    links = graph(seed, 400, span)
    df = spark.createDataFrame([(k, v) for k, v in links.items()], "id string, up string")
    placed = H.hierarchy(df, "id", ["up"], F.substring("id", 2, 9).cast("long"), True, per_task)
    looped = H.loop_descendants(H.cut_loops(placed, per_task)).collect()
    got = [(r["ancestor_id"], r["node"], r["distance"]) for r in looped] + [tuple(r) for r in H.descendants(placed).collect()]
    assert len(got) == len(set(got)) and set(got) == chased(links)
    assert any(not r["on_loop"] for r in looped)
    assert all(r["on_loop"] == on_loop(links, r["ancestor_id"]) for r in looped)


def test_later_runs_query(spark, sf):
    from quernel.queries.corpus import p1_descendants, p1_found, p1_later_runs, p1_loop_paths, p1_paths

    links = {r["run_id"]: r["parent_id"] for r in p1_paths(spark, sf).collect()}
    got = {(r["run_id"], r["later_run_id"], r["distance"]) for r in p1_later_runs(spark, sf).collect()}
    assert got == chased(links) and got > {tuple(r) for r in p1_descendants(spark, sf).collect()}
    cut = {r["run_id"]: r for r in p1_loop_paths(spark, sf).collect()}
    assert set(cut) == {r["run_id"] for r in p1_found(spark, sf).where("depth = -1").collect()}
    assert all(r["path"].split("/")[0] == r["root_id"] and r["path"].split("/")[-1] == n for n, r in cut.items())
