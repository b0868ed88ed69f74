"""Report-style shaping: filter options, pivots with a rest, slices, comparisons, safe CSV, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_OPTIONS, MOST_SERIES, MOST_CATEGORIES, MOST_SLICES, MOST_POINTS, MOST_SNAPSHOTS, MOST_SNAPSHOT_ROWS = 200, 6, 60, 7, 1000, 30, 500


def filter_options(df: DataFrame, column: str, most: int = MOST_OPTIONS) -> DataFrame:
    """The stored values in order, one more than ``most`` at the most, so that a longer list shows."""
    return df.select(F.col(column).alias("option")).where(F.col("option").isNotNull()).distinct().orderBy("option").limit(most + 1)


def with_rest(df: DataFrame, category: str, series: str, measure: str, most: int = MOST_SERIES) -> DataFrame:
    """category, series, total: the largest series by absolute total, all others summed as ``Other (n)``."""
    cells = df.groupBy(F.col(category).alias("category"), F.col(series).alias("series")).agg(F.sum(measure).alias("total"))
    size = cells.groupBy("series").agg(F.sum(F.abs("total")).alias("size"))
    top = size.orderBy(F.desc("size"), "series").limit(most).select(F.col("series").alias("s"), F.lit(True).alias("shown"))
    n = size.agg(F.count(F.lit(1)).alias("n"))
    # Both are bounded: ``most`` rows and one row.
    named = cells.join(F.broadcast(top), cells["series"].eqNullSafe(top["s"]), "left").join(F.broadcast(n))
    name = F.when(F.col("shown"), F.col("series").cast("string")).otherwise(F.concat(F.lit("Other ("), (F.col("n") - most).cast("string"), F.lit(")")))
    return named.groupBy("category", name.alias("series")).agg(F.sum("total").alias("total"))


def pivot(df: DataFrame, category: str, series: str, measure: str, most: int = MOST_SERIES) -> DataFrame:
    """A row for each category, the first ``MOST_CATEGORIES`` in natural order, and a column for each shown series."""
    long = with_rest(df, category, series, measure, most)
    shown = long.select("category").distinct().orderBy(*natural("category")).limit(MOST_CATEGORIES)
    long = long.join(F.broadcast(shown), long["category"].eqNullSafe(shown["category"]), "left_semi")
    names = [r[0] for r in long.select("series").distinct().orderBy("series").limit(most + 1).collect()]
    return long.groupBy("category").pivot("series", names).sum("total")


def slices(df: DataFrame, label: str, measure: str, most: int = MOST_SLICES) -> DataFrame:
    """label, total: the largest positive totals, and the rest in one slice."""
    sums = df.groupBy(F.col(label).cast("string").alias("label")).agg(F.sum(measure).alias("total")).where("total > 0")
    top = sums.orderBy(F.desc("total"), "label").limit(most).select(F.col("label").alias("l"), F.lit(True).alias("shown"))
    joined = sums.join(F.broadcast(top), sums["label"].eqNullSafe(top["l"]), "left")
    return joined.groupBy(F.when(F.col("shown"), F.col("label")).otherwise("Other").alias("label")).agg(F.sum("total").alias("total"))


def points(df: DataFrame, x: str, y: str, most: int = MOST_POINTS) -> DataFrame:
    """The points of a scatter: rows with both numbers, up to a limit, in order."""
    return df.select(F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null").orderBy("x", "y").limit(most)


def natural(label: str) -> list[Column]:
    """The order of labels as people read them: numbers inside by their value, letter case last."""
    c = F.col(label).cast("string")
    padded = F.regexp_replace(F.regexp_replace(F.lower(c), r"(\d+)", "000000000000000000$1"), r"0*(\d{18})(?!\d)", "$1")
    return [padded.asc_nulls_last(), c.asc_nulls_last()]


def arranged(df: DataFrame, label: str, measure: str, how: str = "value_desc", most: int | None = None) -> DataFrame:
    """Rows in a chart's order, up to a limit."""
    orders = {"value_desc": [F.desc_nulls_last(measure), *natural(label)], "value_asc": [F.asc_nulls_last(measure), *natural(label)], "label": natural(label)}
    out = df.orderBy(*orders[how])
    return out.limit(most) if most else out


def compared(df: DataFrame, order: str, measure: str, target: float | None = None) -> DataFrame:
    """value, against, change, change_percent of the first row: against the second, or a target."""
    w = Window.orderBy(F.desc(order))
    against = F.lit(target).cast("double") if target is not None else F.lead(measure).over(w)
    first = df.orderBy(F.desc(order)).limit(2).select(F.col(measure).cast("double").alias("value"), against.cast("double").alias("against"), F.row_number().over(w).alias("rn")).where("rn = 1")
    change = F.col("value") - F.col("against")
    return first.select("value", "against", change.alias("change"), F.when(F.col("against") != 0, change / F.abs("against") * 100).alias("change_percent"))


def suggested_chart(df: DataFrame) -> str:
    """The chart that a result's columns suggest: number, line, bar, scatter or table."""
    kinds = ["time" if f.dataType.typeName() in ("date", "timestamp", "timestamp_ntz") else "number" if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte", "decimal") else "text" for f in df.schema.fields]
    measures = [k for k, f in zip(kinds, df.schema.fields, strict=True) if k == "number" and not (f.name.lower() == "id" or f.name.lower().endswith("_id"))]
    if kinds == ["number"]:
        return "number"
    if "time" in kinds and measures:
        return "line"
    if "text" in kinds and measures:
        return "bar"
    return "scatter" if len(measures) >= 2 else "table"


def labels_collapse(df: DataFrame, label: str) -> DataFrame:
    """n_rows, n_labels, collapses: whether a chart by this label would lay rows on top of each other."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(label).alias("n_labels")).withColumn("collapses", F.col("n_labels") < F.col("n_rows"))


def csv_safe(c: Column) -> Column:
    """A text cell that no spreadsheet takes for a formula: numbers stay, other text starting like one gets a quote."""
    risky = c.rlike(r"^[=+\-@\t\r]") & ~c.rlike(r"^[+-]?\d+([.,]\d+)*([eE][+-]?\d+)?$")
    return F.when(risky, F.concat(F.lit("'"), c)).otherwise(c)


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted CSV with a header, formulas made harmless, lines ending in CRLF."""
    safe = df.select(*(csv_safe(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() == "string" else F.col(f"`{f.name}`") for f in df.schema.fields))
    safe.write.mode("overwrite").option("header", True).option("escape", '"').option("lineSep", "\r\n").csv(path)


def latest_snapshots(df: DataFrame, report: str, taken_at: str, snapshot: str, most: int = MOST_SNAPSHOTS) -> DataFrame:
    """The latest snapshots of each report; repeated rows count once.

    Done in two steps: a hot report's rows are first thinned in salted parts.
    """
    rows = df.dropDuplicates([snapshot])
    salt = F.pmod(F.xxhash64(snapshot), F.lit(32))
    order = [F.desc(taken_at), F.desc(snapshot)]
    part = Window.partitionBy(report, "__salt").orderBy(*order)
    thin = rows.withColumn("__salt", salt).withColumn("__rn", F.row_number().over(part)).where(F.col("__rn") <= most)
    whole = Window.partitionBy(report).orderBy(*order)
    return thin.withColumn("__rn", F.row_number().over(whole)).where(F.col("__rn") <= most).drop("__salt", "__rn")
