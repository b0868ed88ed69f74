"""Checks of results: impossible percentages, empty answers, ties, readings, probes."""

from __future__ import annotations

import re
from collections import Counter
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PERCENT = re.compile(r"percent|pct", re.I)


def percent_out_of_range(df: DataFrame) -> DataFrame:
    """column, lowest, highest, n_outside of numeric columns that are named percentages and leave 0 to 100."""
    marked = [f.name for f in df.schema.fields if PERCENT.search(f.name) and f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte", "decimal")]
    if not marked:
        return df.sparkSession.createDataFrame([], "column string, lowest double, highest double, n_outside long")
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in marked)))
    per = df.select(cells.alias("x")).select("x.column", "x.v").groupBy("column")
    out = per.agg(F.min("v").alias("lowest"), F.max("v").alias("highest"), F.sum(F.when((F.col("v") < 0) | (F.col("v") > 100), 1).otherwise(0)).alias("n_outside"))
    return out.where("n_outside > 0")


def looks_empty(rows: list[dict[str, Any]]) -> bool:
    """No rows, or a single one that holds nothing but nulls and zeros."""
    return not rows or len(rows) == 1 and all(v is None or v == 0 for v in rows[0].values())


def same_reading(a: DataFrame, b: DataFrame) -> DataFrame:
    """same_width, only_a, only_b: whether two readings of a question give the same rows, order and names aside."""
    spark = a.sparkSession
    if len(a.columns) != len(b.columns):
        return spark.createDataFrame([(False, None, None)], "same_width boolean, only_a long, only_b long")
    names = [f"c{i}" for i in range(len(a.columns))]
    x, y = a.toDF(*names), b.toDF(*names)
    left = x.withColumn("side", F.lit(1)).unionByName(y.withColumn("side", F.lit(-1)))
    diff = left.groupBy(*names).agg(F.sum("side").alias("d"))
    return diff.agg(
        F.lit(True).alias("same_width"),
        F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("d"))), F.lit(0)).alias("only_a"),
        F.coalesce(F.sum(F.when(F.col("d") < 0, -F.col("d"))), F.lit(0)).alias("only_b"),
    )


def same_rows(a: list[tuple], b: list[tuple]) -> bool:
    """The same for bounded rows at hand."""
    return Counter(a) == Counter(b)


def probe_report(df: DataFrame) -> DataFrame:
    """column, n_rows, n_distinct, n_null of every column, in one pass."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(df.columns):
        aggs += [F.countDistinct(F.col(f"`{c}`")).alias(f"d{i}"), F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(f"z{i}")]
    one = df.agg(*aggs)
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), F.col(f"d{i}").alias("n_distinct"), F.col(f"z{i}").alias("n_null")) for i, c in enumerate(df.columns))))
    return one.select(cells.alias("x")).select("x.*")


def out_of_order(rows: list[dict[str, Any]], measure: str) -> int:
    """How many of a bounded result's rows have a larger measure than the row before; 0 if it is in falling order."""
    values = [r[measure] for r in rows if r[measure] is not None]
    return sum(b > a for a, b in zip(values, values[1:], strict=False))
