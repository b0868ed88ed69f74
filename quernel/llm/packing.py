"""Filling fixed-capacity containers with items of varying length.

Each partition packs its items online by best fit, with a fixed number of open
bins. A bitset holds a bit for each amount of free space that some open bin
has, so the best bin is the lowest set bit from the item's size on; when no bin
fits and all places are taken, the fullest closes. Bins still open at a
partition's end are packed again as items, in the same way and with as many open
bins, by fewer and fewer tasks until one is left, so that partitions cost no
space.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.workspace import materialise

OPEN_BINS = 256
#: Items of size 0 that wait for a closed bin to go into, at most.
WAITING = 10_000
#: Bins left open that one task packs again.
BINS_PER_TASK = 16_384
PACKED = "container long, item long, piece int, start long, size long, open boolean"
_OUT = pa.schema([("container", pa.int64()), ("item", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("size", pa.int64()), ("open", pa.bool_())])
#: Containers are numbered by level of packing, partition and bin.
_LEVEL, _PART = 60, 40


class BestFit:
    """Bounded-space online best fit over bins numbered from 0."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.open_bins = capacity, open_bins
        self.free: dict[int, list[int]] = {}
        self.bits = 0
        self.n_open = 0
        self.next_bin = 0
        self.closed: int | None = None  # a bin that is closed for good

    def _hold(self, free: int, bin_no: int) -> None:
        if free:
            self.free.setdefault(free, []).append(bin_no)
            self.bits |= 1 << free
            self.n_open += 1
        else:
            self.closed = bin_no

    def _take(self, free: int) -> int:
        bins = self.free[free]
        bin_no = bins.pop()
        if not bins:
            del self.free[free]
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return bin_no

    def new_bin(self) -> int:
        self.next_bin += 1
        return self.next_bin - 1

    def full_bin(self) -> int:
        """A new bin that is closed at once."""
        self.closed = self.new_bin()
        return self.closed

    def place(self, size: int) -> int:
        """The bin of an item of at most the capacity."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            bin_no = self._take(free)
        else:
            if self.n_open >= self.open_bins:
                self.closed = self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            bin_no, free = self.new_bin(), self.capacity
        self._hold(free - size, bin_no)
        return bin_no

    def still_open(self) -> set[int]:
        return {b for bins in self.free.values() for b in bins}


def _pack(capacity: int, open_bins: int, level: int = 0):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer = BestFit(capacity, open_bins)
        held: list[tuple] = []  # rows of bins that may still be open
        waiting: list[int | None] = []  # items of size 0
        for b in batches:
            out: list[tuple] = []
            for item, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if size == 0:
                    waiting.append(item)
                    continue
                piece, start = 0, 0
                while size - start > capacity:
                    out.append((packer.full_bin(), item, piece, start, capacity))
                    piece, start = piece + 1, start + capacity
                held.append((packer.place(size - start), item, piece, start, size - start))
            if waiting and (packer.closed is not None or len(waiting) > WAITING):
                home = packer.closed if packer.closed is not None else packer.full_bin()
                out += [(home, item, 0, 0, 0) for item in waiting]
                waiting = []
            still = packer.still_open()
            out += [r for r in held if r[0] not in still]
            held = [r for r in held if r[0] in still]
            yield _frame(out, part, False)
        if waiting:
            home = packer.place(0)
            held += [(home, item, 0, 0, 0) for item in waiting]
        still = packer.still_open()
        yield _frame([r for r in held if r[0] not in still], part, False)
        yield _frame([r for r in held if r[0] in still], part, True)

    def _frame(rows: list[tuple], part: int, is_open: bool) -> pa.RecordBatch:
        first = (level << _LEVEL) + (part << _PART)
        container, item, piece, start, size = zip(*rows, strict=True) if rows else ((),) * 5
        return pa.RecordBatch.from_arrays(
            [pa.array([first + c for c in container], pa.int64()), pa.array(item, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array([is_open] * len(rows), pa.bool_())],
            schema=_OUT,
        )

    return run


def pack(df: DataFrame, item: str, size: str, capacity: int, open_bins: int = OPEN_BINS) -> DataFrame:
    """container, item, piece, start, size: every item, or piece of one, in its container.

    Only an item larger than the capacity is split: into full containers and a
    rest, which is packed as an item. Items of size 0 or null take no space but
    have a container, as a rule one closed before. Items are ordered by id first, so results repeat. Repeated ids are separate
    items; null ids too. An empty input gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    rows = df.select(F.col(f"`{item}`").cast("long").alias("item"), F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("long").alias("size"))
    rows = materialise(rows, "sizes")
    placed = rows.repartitionByRange("item", "size").sortWithinPartitions("item", "size")
    packed = materialise(placed.mapInArrow(_pack(capacity, open_bins), PACKED), "packed")
    joint = _joined(packed.where("open"), capacity, open_bins, 1)
    rest = packed.where("open").join(joint, "container").select(F.col("joint").alias("container"), "item", "piece", "start", "size")
    return packed.where(~F.col("open")).select("container", "item", "piece", "start", "size").unionByName(rest)


def _joined(left: DataFrame, capacity: int, open_bins: int, level: int) -> DataFrame:
    """container, joint: the container into which each bin left open goes, as an item of the size of its content.

    A task takes many times the bins that it leaves open, so the next level has
    far fewer; the last has one task.
    """
    bins = materialise(left.groupBy("container").agg(F.sum("size").alias("size")), "open")
    tasks = max(1, -(-bins.count() // max(BINS_PER_TASK, 2 * open_bins)))
    again = bins.select(F.col("container").alias("item"), "size").repartition(tasks, "item").sortWithinPartitions("item")
    moved = again.mapInArrow(_pack(capacity, open_bins, level), PACKED)
    if tasks == 1:
        return moved.select(F.col("item").alias("container"), F.col("container").alias("joint"))
    moved = materialise(moved, "moved")
    higher = _joined(moved.where("open"), capacity, open_bins, level + 1).withColumnRenamed("container", "at").withColumnRenamed("joint", "top")
    joined = moved.join(higher, F.col("container") == F.col("at"), "left")
    return joined.select(F.col("item").alias("container"), F.coalesce("top", F.col("container")).alias("joint"))


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """n_containers, n_tokens, least (containers that no packing can do without), filled (share of space used)."""
    bins = packed.groupBy("container").agg(F.sum("size").alias("size"))
    n, total = F.count(F.lit(1)), F.sum("size")
    return bins.agg(n.alias("n_containers"), total.alias("n_tokens"), F.ceil(total / F.lit(capacity)).alias("least"), (total / (n * F.lit(capacity))).alias("filled"))
