"""Percentiles of very large numeric columns, by merging centroid digests.

A digest clusters sorted values so that a cluster's size shrinks towards the
tails (the arcsine size function); digests merge by clustering their centroids
again. Each partition digests its own values by (group, day), so what is moved
is centroids; daily digests are kept and combine to any longer time. A second,
counting pass over the values measures the rank error of every percentile; a
group beyond the stated bound is digested again with eight times the centroids,
twice at most, and what is still beyond it is read off the values in order,
sorted by ranges, so that no task ever holds all values of a group.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.workspace import materialise

COMPRESSION = 200
RANK_ERROR = 0.005
PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
#: Digests that one task merges at most, where partitions are more.
FAN_IN = 256
#: How often a group is digested again with eight times the centroids.
AGAIN = 2
#: Groups up to this number are broadcast in the counting pass; beyond it they are joined by shuffle.
BROADCAST_GROUPS = 50_000


def cluster(means: np.ndarray, weights: np.ndarray, compression: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids (means, weights), sorted, of weighted values in any order."""
    order = np.argsort(means, kind="stable")
    means, weights = means[order], weights[order]
    if len(means) <= compression:
        return means, weights
    total = weights.sum()
    q = (np.cumsum(weights) - weights / 2) / total
    k = np.floor(compression * (np.arcsin(2 * q - 1) / np.pi + 0.5))
    at = np.concatenate([[0], np.flatnonzero(np.diff(k)) + 1])
    w = np.add.reduceat(weights, at)
    return np.add.reduceat(means * (weights / 1.0), at) / w, w


def quantile(means: np.ndarray, weights: np.ndarray, low: float, high: float, q: float) -> float:
    """The value at rank q, interpolated between the centroids' middles."""
    total = weights.sum()
    mids = np.cumsum(weights) - weights / 2
    return float(np.interp(q * total, np.concatenate([[0], mids, [total]]), np.concatenate([[low], means, [high]])))


DIGEST = "means array<double>, weights array<double>, low double, high double, n long"


def _row(values: np.ndarray, weights: np.ndarray, low: float, high: float, n: int, compression: int) -> tuple:
    m, w = cluster(values, weights, compression)
    return m, w, float(low), float(high), int(n)


def partial_digests(df: DataFrame, keys: list[str], value: str, compression: int) -> DataFrame:
    """One digest for each partition and combination of keys; nothing is shuffled."""
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", " + DIGEST

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for pdf in batches:
            for key, part in pdf.groupby(keys, dropna=False, sort=False):
                v = part[value].to_numpy(dtype=float)
                key = tuple(None if pd.isna(x) else x for x in key)
                old = held.get(key)
                values, weights, low, high, n = np.concatenate([old[0], v]) if old else v, np.concatenate([old[1], np.ones(len(v))]) if old else np.ones(len(v)), v.min(), v.max(), len(v)
                if old:
                    low, high, n = min(low, old[2]), max(high, old[3]), n + old[4]
                held[key] = list(_row(values, weights, low, high, n, compression))
        if held:
            rows = [(*k, *v) for k, v in held.items()]
            yield pd.DataFrame(rows, columns=[*keys, "means", "weights", "low", "high", "n"])

    return df.select(*keys, value).mapInPandas(run, schema)


def merge_digests(digests: DataFrame, keys: list[str], compression: int) -> DataFrame:
    """One digest for each combination of keys; the input may itself be merged digests.

    A task goes through its digests in order of keys and holds those of one key:
    as many as there are days, or see ``digests``. The number of tasks is that
    of shuffle partitions, whatever the bytes, as the work isn't in the bytes.
    """
    schema = ", ".join(f"`{k}` {digests.schema[k].dataType.simpleString()}" for k in keys) + ", " + DIGEST
    names = [*keys, "means", "weights", "low", "high", "n"]

    def merged(key: tuple, some: list[tuple]) -> tuple:
        means, weights, low, high, n = zip(*some, strict=True)
        return (*key, *_row(np.concatenate(means), np.concatenate(weights), min(low), max(high), sum(n), compression))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for pdf in batches:
            out = []
            cells = [[None if pd.isna(x) else x for x in pdf[k]] for k in keys]
            for row in zip(zip(*cells, strict=True), pdf["means"], pdf["weights"], pdf["low"], pdf["high"], pdf["n"], strict=True):
                if held and row[0] != key:
                    out.append(merged(key, held))
                    held = []
                key = row[0]
                held.append(row[1:])
            if out:
                yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame([merged(key, held)], columns=names)

    n = int(digests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return digests.select(*names).repartition(n, *keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def digests(values: DataFrame, keys: list[str], value: str, compression: int = COMPRESSION) -> DataFrame:
    """One digest for each combination of keys, of all values.

    Digests of more partitions than ``FAN_IN`` are merged in two steps, by
    salted parts first, so that no task holds more than a bounded number.
    """
    parts = partial_digests(values, keys, value, compression)
    n = values.rdd.getNumPartitions()
    if n > FAN_IN:
        salted = parts.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(-(-n // FAN_IN))))
        parts = merge_digests(salted, [*keys, "__salt"], compression).drop("__salt")
    return merge_digests(parts, keys, compression)


def read_percentiles(digests: DataFrame, keys: list[str], percentiles: tuple[float, ...]) -> DataFrame:
    """keys, n, estimates (one for each percentile)."""

    @F.pandas_udf("array<double>")
    def read(means: pd.Series, weights: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        return pd.Series([[quantile(np.asarray(m), np.asarray(w), lo, hi, q) for q in percentiles] for m, w, lo, hi in zip(means, weights, low, high, strict=True)])

    return digests.select(*keys, "n", read("means", "weights", "low", "high").alias("estimates"))


def certify(values: DataFrame, keys: list[str], value: str, estimates: DataFrame, percentiles: tuple[float, ...]) -> DataFrame:
    """keys, n, percentile, estimate, n_below, n_equal, rank_error, by counting all values."""
    e = materialise(estimates, "estimates")
    small = e.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    right = e.select(*(F.col(k).alias(f"__{k}") for k in keys), "n", "estimates")
    same = _same(keys)
    joined = values.select(*keys, F.col(value).alias("__v")).join(F.broadcast(right) if small else right, same)
    return _certificate(joined, keys, percentiles)


def _certificate(joined: DataFrame, keys: list[str], percentiles: tuple[float, ...]) -> DataFrame:
    counts = []
    for i in range(len(percentiles)):
        at = F.col("estimates")[i]
        counts += [F.sum((F.col("__v") < at).cast("long")).alias(f"b{i}"), F.sum((F.col("__v") == at).cast("long")).alias(f"e{i}")]
    counted = joined.groupBy(*keys).agg(F.first("n").alias("n"), F.first("estimates").alias("estimates"), *counts)
    rows = F.explode(F.array(*(F.struct(F.lit(q).alias("percentile"), F.col("estimates")[i].alias("estimate"), F.col(f"b{i}").alias("n_below"), F.col(f"e{i}").alias("n_equal")) for i, q in enumerate(percentiles))))
    target = F.col("percentile") * F.col("n")
    off = F.greatest(F.col("n_below") - target, target - F.col("n_below") - F.col("n_equal"), F.lit(0.0)) / F.col("n")
    return counted.select(*keys, "n", rows.alias("r")).select(*keys, "n", "r.*").withColumn("rank_error", off)


def percentiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    day: str,
    quantiles: tuple[float, ...] = PERCENTILES,
    rank_error: float = RANK_ERROR,
    compression: int = COMPRESSION,
) -> DataFrame:
    """keys, n, percentile, estimate, n_below, n_equal, rank_error (at most ``rank_error``).

    ``df`` holds the values to count, without nulls and NaN (see
    ``possible_values``). A null key is a group of its own. The error is in
    rank, as a share of the group's values; where no value has the wanted rank
    exactly, one between its neighbours counts as right (error at most 1/n). An
    empty input gives no rows.
    """
    values = materialise(df.select(*keys, day, value), "values")
    out, todo = None, values
    for last in [False] * AGAIN + [True]:
        daily = digests(todo, [*keys, day], value, compression)
        whole = merge_digests(daily, keys, compression)
        done = materialise(certify(todo, keys, value, read_percentiles(whole, keys, quantiles), quantiles), "certified")
        bad = done.where(F.col("rank_error") > F.greatest(F.lit(rank_error), 1 / F.col("n"))).select(*keys).distinct()
        if bad.isEmpty():
            return done if out is None else out.unionByName(done)
        marks = bad.select(*(F.col(k).alias(f"__{k}") for k in keys))
        same = _same(keys)
        good = done.join(marks, same, "left_anti")
        out = good if out is None else out.unionByName(good)
        todo = todo.join(marks, same, "left_semi")
        if last:
            return out.unionByName(exact(todo, keys, value, quantiles))
        compression *= 8


def _same(keys: list[str]) -> Column:
    return functools.reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))


def exact(df: DataFrame, keys: list[str], value: str, quantiles: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """As ``percentiles``, with the stored value at rank ceil(q n): counted values in order, by ranges.

    Values are counted first, so equal ones are one row, and lie in ranges of
    (keys, value); a group may span many. What goes round between the ranges is
    one count for each group in each.
    """
    rows = df.groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ordered = materialise(materialise(rows, "counted").repartitionByRange(*keys, "v").withColumn("part", F.spark_partition_id()), "ordered")
    own = ordered.groupBy(*keys, "part").agg(F.sum("c").alias("s"))
    w = Window.partitionBy(*keys).orderBy("part")
    whole = Window.partitionBy(*keys)
    sums = own.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("part").alias("at"), (F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("s")).alias("before"), F.sum("s").over(whole).alias("n"))
    inside = Window.partitionBy(*keys, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = ordered.withColumn("upto", F.sum("c").over(inside)).join(sums, _same(keys) & (F.col("part") == F.col("at")))
    below, upto = F.col("before") + F.col("upto") - F.col("c"), F.col("before") + F.col("upto")
    each = F.filter(F.array(*(F.struct(F.lit(float(q)).alias("percentile"), F.greatest(F.ceil(F.lit(q) * F.col("n")), F.lit(1)).alias("rank")) for q in quantiles)), lambda x: (x["rank"] > below) & (x["rank"] <= upto))
    return placed.select(*keys, "n", F.explode(each).alias("x"), F.col("v").alias("estimate"), below.alias("n_below"), F.col("c").alias("n_equal")).select(
        *keys, "n", F.col("x.percentile").alias("percentile"), F.col("estimate").cast("double").alias("estimate"), "n_below", "n_equal", F.lit(0.0).alias("rank_error")
    )


def possible_values(df: DataFrame, value: str, above: float | None = None) -> DataFrame:
    """Rows whose value can have been measured: neither null, NaN nor infinite and, if ``above`` is given, larger than that."""
    v = F.col(value)
    found = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return found if above is None else found.where(v > above)
