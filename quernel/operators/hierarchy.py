"""Parent-child links to full hierarchies.

Weighted disjoint-set forests: each partition of links builds a forest over
its own links, in which every node knows the topmost node it can reach there
and the offset (steps) to it. Only the topmost nodes that have a link in some
other partition matter further: they form a contracted, weighted set of links,
which is solved the same way with fewer partitions, until it fits one task.
Then offsets are added back down the levels. Loops are found where a forest
closes on itself, at whatever level that happens, and are named by their
smallest id. Paths are materialised the same way: each forest walks its own
parent index, and the pieces are put together on the way down.

Parts hold about ``LINKS_PER_TASK`` links at most (range bounds are sampled), and
all cores get some where there are enough. Where links have no locality, so
that their ranges don't shrink them, later levels place them by coins instead:
each node throws one, and a link from a node with tails to one with heads lies
with its parent's own link. Leaves vanish at every level and a quarter of the
nodes with one child do, whatever the order of ids, so the levels are few and the
method stays the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.workspace import materialise

LINKS_PER_TASK = 100_000
#: A task of fewer links isn't worth its start.
LEAST_LINKS = 2_000
#: Ranges that leave more than this share of the links have no locality to use.
SHRINK = 0.7
BATCH_IDS = 200_000

FOREST = "node string, top string, steps long, lo string, loop boolean, seg array<string>, near long"
_COLUMNS = ["node", "top", "steps", "lo", "loop", "seg", "near"]


def forest(batches: Iterator[pd.DataFrame], with_paths: bool) -> Iterator[pd.DataFrame]:
    """The weighted forest of one partition's links (node, parent, w, lo, seg, near).

    Gives for each node the topmost node reached, the steps to it, the smallest
    id on the way (without the top) and, if asked, the ids on the way from
    below the top down to the node. On or below a loop: loop is true and top
    the loop's smallest id.
    """
    up: dict[str, str] = {}
    weight: dict[str, int] = {}
    low: dict[str, str] = {}
    near: dict[str, int] = {}
    segs: dict[str, list[str]] = {}
    for pdf in batches:
        up.update(zip(pdf["node"], pdf["parent"], strict=True))
        weight.update(zip(pdf["node"], pdf["w"], strict=True))
        low.update(zip(pdf["node"], pdf["lo"], strict=True))
        near.update(zip(pdf["node"], pdf["near"], strict=True))
        if with_paths:
            segs.update((n, list(s)) for n, s in zip(pdf["node"], pdf["seg"], strict=True))
    found: dict[str, tuple[str, int, str, bool]] = {}
    for start in up:
        if start in found:
            continue
        chain: list[str] = []
        at: dict[str, int] = {}
        x = start
        while x in up and x not in found and x not in at:
            at[x] = len(chain)
            chain.append(x)
            x = up[x]
        if x in at:  # a loop closes here
            name = min(low[y] for y in chain[at[x] :])
            found.update((y, (name, -1, name, True)) for y in chain)
            continue
        top, steps, lo, loop = found.get(x) or (x, 0, "", False)
        for y in reversed(chain):
            if not loop:
                steps += weight[y]
                lo = min(lo, low[y]) if lo else low[y]
            found[y] = (top, steps, lo, loop)
    rows: list[tuple] = []
    held = 0
    for node, (top, steps, lo, loop) in found.items():
        seg = None
        if with_paths and not loop:
            pieces, x = [], node
            while x != top:
                pieces.append(segs[x])
                x = up[x]
            seg = [i for p in reversed(pieces) for i in p]
            held += len(seg)
        rows.append((node, top, steps, lo, loop, seg, near[node]))
        held += 1
        if held > BATCH_IDS:
            yield pd.DataFrame(rows, columns=_COLUMNS)
            rows, held = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=_COLUMNS)


def _above(solved: DataFrame) -> DataFrame:
    return solved.select(F.col("node").alias("top"), *(F.col(c).alias(f"{c}2") for c in ("top", "steps", "lo", "loop", "seg")))


def _placed(links: DataFrame, parts: int, per_task: int, level: int, by_coins: bool) -> DataFrame:
    """The links in ``parts`` partitions: by ranges of ``near``, or by coins that differ from level to level.

    A parent with so many children that they would fill a good part of a task
    counts as tails, so its children stay spread; there are few such parents.
    """
    if parts == 1:
        return links.coalesce(1)
    if not by_coins:
        return links.repartitionByRange(parts, "near", "node")
    heads = lambda c: F.pmod(F.xxhash64(c, F.lit(level)), F.lit(2)) == 1
    hot = links.groupBy("parent").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(1, per_task // 4)).select("parent", F.lit(True).alias("hot"))
    joined = links.join(hot, "parent", "left")
    key = F.when(heads("parent") & ~heads("node") & F.col("hot").isNull(), F.col("parent")).otherwise(F.col("node"))
    return joined.drop("hot").repartition(parts, key)


def solve(links: DataFrame, n: int, with_paths: bool, per_task: int = LINKS_PER_TASK, level: int = 0, by_coins: bool = False) -> DataFrame:
    """FOREST rows, fully resolved, of the ``n`` links (node, parent, w, lo, seg, near)."""
    cores = links.sparkSession.sparkContext.defaultParallelism
    parts = max(1, math.ceil(n / per_task), min(cores, n // LEAST_LINKS))
    local = _placed(links, parts, per_task, level, by_coins).mapInPandas(lambda it: forest(it, with_paths), FOREST)
    if parts == 1:
        return local
    local = materialise(local, "forest")
    tops = local.where(~F.col("loop")).select(F.col("top").alias("node")).distinct()
    # A node whose own forest is a loop keeps the loop's name: it is linked to itself.
    contracted = materialise(
        local.join(tops, "node", "left_semi").select(
            "node",
            F.when(F.col("loop"), F.col("node")).otherwise(F.col("top")).alias("parent"),
            F.when(F.col("loop"), F.lit(1)).otherwise(F.col("steps")).cast("long").alias("w"),
            "lo",
            F.coalesce("seg", F.array().cast("array<string>")).alias("seg"),
            "near",
        ),
        "contracted",
    )
    m = contracted.count()
    if m == 0:
        return local
    higher = materialise(solve(contracted, m, with_paths, per_task, level + 1, by_coins or m > SHRINK * n), "higher")
    far = F.col("top2").isNotNull() & ~F.col("loop")
    closed = far & F.col("loop2")
    return local.join(_above(higher), "top", "left").select(
        "node",
        F.when(far, F.col("top2")).otherwise(F.col("top")).alias("top"),
        F.when(closed, F.lit(-1)).when(far, F.col("steps") + F.col("steps2")).otherwise(F.col("steps")).alias("steps"),
        F.when(far, F.least("lo", "lo2")).otherwise(F.col("lo")).alias("lo"),
        F.when(far, F.col("loop2")).otherwise(F.col("loop")).alias("loop"),
        F.when(closed, F.lit(None)).when(far, F.concat("seg2", "seg")).otherwise(F.col("seg")).alias("seg"),
        "near",
    )


def normal_id(c: Column) -> Column:
    """An id without padding and letter case; null if blank."""
    bare = F.lower(F.regexp_replace(c, r"^[\s\u00a0]+|[\s\u00a0]+$", ""))
    return F.when(bare != "", bare)


def hierarchy(
    df: DataFrame,
    node: str,
    pointers: list[str],
    near: Column | None = None,
    with_paths: bool = False,
    per_task: int = LINKS_PER_TASK,
) -> DataFrame:
    """Every node's place: node, parent_id, root_id, depth, in_loop and, if asked, path.

    The pointer is the first of ``pointers`` that is neither null nor blank; it
    counts if, padding and letter case aside, it names a node. Ids come out
    without padding, in lower case. A node without such a pointer is a root:
    its own root_id, depth 0. On or below a loop depth is -1, root_id the
    loop's smallest id and path null. ``path`` lists the ids from the root to
    the node. Rows with one id are one node (the least pointer counts); rows
    with a null or blank id are no nodes; an empty input gives no rows. Other
    columns are ignored.

    ``near`` is a number by which children tend to lie close to their parents,
    such as a time; without it links are placed by hash.
    """
    given = F.coalesce(*(normal_id(F.col(f"`{p}`")) for p in pointers))
    keyed = df.select(normal_id(F.col(f"`{node}`")).alias("node"), given.alias("parent"), (near if near is not None else F.lit(None)).cast("long").alias("near"))
    nodes = keyed.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("parent").alias("parent"), F.min("near").alias("near"))
    nodes = materialise(nodes.withColumn("near", F.coalesce("near", F.xxhash64("node"))), "nodes")
    named = nodes.select(F.col("node").alias("parent"))
    links = materialise(
        nodes.where(F.col("parent").isNotNull())
        .join(named, "parent", "left_semi")
        .select("node", "parent", F.lit(1).cast("long").alias("w"), F.col("node").alias("lo"), F.array("node").alias("seg"), "near"),
        "links",
    )
    solved = solve(links, links.count(), with_paths, per_task)
    placed = solved.join(links.select("node", "parent"), "node").select(
        "node",
        F.col("parent").alias("parent_id"),
        F.col("top").alias("root_id"),
        F.col("steps").cast("int").alias("depth"),
        F.col("loop").alias("in_loop"),
        F.when(~F.col("loop"), F.concat(F.array("top"), "seg")).alias("path"),
    )
    roots = nodes.join(links.select("node"), "node", "left_anti").select(
        "node",
        F.lit(None).cast("string").alias("parent_id"),
        F.col("node").alias("root_id"),
        F.lit(0).alias("depth"),
        F.lit(False).alias("in_loop"),
        F.array("node").alias("path"),
    )
    out = placed.unionByName(roots)
    return out if with_paths else out.drop("path")


def descendants(placed: DataFrame) -> DataFrame:
    """ancestor_id, node, distance: every node below every other, from ``path``.

    Nodes on or below loops have no path and give no rows; ``loop_descendants``
    has theirs.
    """
    below = placed.where(F.size("path") > 1).select("node", "depth", F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("at", "ancestor_id"))
    return below.select("ancestor_id", "node", (F.col("depth") - F.col("at")).cast("int").alias("distance"))


def threads(pairs: DataFrame, placed: DataFrame, most: int) -> DataFrame:
    """node, thread: each node with the nodes that lead to it, earliest first, ``most`` of them at the most.

    ``pairs`` has ancestor_id, node, distance (see ``descendants`` and
    ``loop_descendants``); a way that comes back to itself ends there. No group
    holds more than ``most`` ids.
    """
    near = pairs.where(F.col("distance") < most).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("distance", "ancestor_id")), asc=False).alias("above"))
    ids = F.concat(F.coalesce(F.transform("above", lambda x: x["ancestor_id"]), F.array().cast("array<string>")), F.array("node"))
    return placed.select("node").join(near, "node", "left").select("node", ids.alias("thread"))


def cut_loops(placed: DataFrame, per_task: int = LINKS_PER_TASK) -> DataFrame:
    """The nodes on or below loops: node, root_id, path, ring, entry.

    Each loop is cut above its smallest id, which leaves a tree below that id:
    ``path`` lists the ids from it to the node, ``ring`` those of the loop in
    the same order, and ``entry`` says how many ids of ``path`` are on the loop.
    """
    looped = placed.where("in_loop").select("node", "parent_id", "root_id")
    ends = looped.where(F.col("node") == F.col("root_id")).select("root_id", F.col("parent_id").alias("last"))
    links = materialise(
        looped.where(F.col("node") != F.col("root_id")).select(
            "node",
            F.col("parent_id").alias("parent"),
            F.lit(1).cast("long").alias("w"),
            F.col("node").alias("lo"),
            F.array("node").alias("seg"),
            F.xxhash64("root_id").alias("near"),  # a loop and what is below it lie together
        ),
        "cut",
    )
    solved = solve(links, links.count(), True, per_task).select("node", F.col("top").alias("root_id"), F.concat(F.array("top"), "seg").alias("path"))
    tops = ends.select(F.col("root_id").alias("node"), "root_id", F.array("root_id").alias("path"))
    trees = materialise(solved.unionByName(tops), "trees")
    rings = trees.join(ends.withColumnRenamed("last", "node"), ["node", "root_id"]).select("root_id", F.col("path").alias("ring"))
    return trees.join(rings, "root_id").select("node", "root_id", "path", "ring", F.size(F.array_intersect("path", "ring")).alias("entry"))


def loop_descendants(cut: DataFrame) -> DataFrame:
    """ancestor_id, node, distance, on_loop: every node from which a way down leads to a node on or below a loop.

    Each pair comes once, with the fewest steps, and no node is its own
    ancestor; ``on_loop`` says that the ancestor is on the loop. The way up
    goes along the path and on, from the loop's smallest id, around the loop
    until just before where the path left it.
    """
    steps = F.size("path") - 1
    along = F.transform(
        F.slice("path", F.lit(1), steps),
        lambda a, i: F.struct(a.alias("ancestor_id"), (steps - i).alias("distance"), (i < F.col("entry")).alias("on_loop")),
    )
    around = F.transform(
        F.slice("ring", F.col("entry") + 1, F.size("ring")),
        lambda a, i: F.struct(a.alias("ancestor_id"), (steps + F.size("ring") - F.col("entry") - i).alias("distance"), F.lit(True).alias("on_loop")),
    )
    return cut.select("node", F.explode(F.concat(along, around)).alias("a")).select("a.ancestor_id", "node", F.col("a.distance").cast("int").alias("distance"), "a.on_loop")
