"""What columns store: shares of nulls and blanks, complete domains, patterns, separators, keys.

All columns of a table are profiled in one scan each: the columns are stacked
into (column, value) rows and aggregated with map-side combination, so hot
values cost no more than others.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Limits of what counts as a known domain.
MOST_VALUES, LONGEST_VALUE, LEAST_COVERAGE, MOST_COUNTED = 30, 60, 0.99, 200
LEAST_SHARE, LEAST_SEPARATED, LONGEST_LIST = 0.01, 0.1, 60
SEPARATORS = (",", ";", "|")
#: Codes and dates stored as text.
FORMAT = r"^[0-9][0-9:/\-. T+]*$"
# Words of a column's name that say its values are personal or secret; "name" does only after one of the second list.
PERSONAL = "mail email phone mobile address street zip postal ssn passport password passwd secret token iban birth dob surname firstname lastname fullname cardnumber cardnum accountnumber accountnum socialsecurity".split()
WHOSE = "first last full".split()


def stacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value: one row for each cell, values as text."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns))
    return df.select(F.explode(pairs).alias("x")).select("x.column", "x.value")


def shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, null_share, blank_share (two decimals; of all rows; less than ``LEAST_SHARE`` counts as none)."""
    cells = stacked(df, columns)
    n = F.count(F.lit(1))
    of = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    share = lambda c: F.when(of(c) >= LEAST_SHARE, F.round(of(c), 2)).otherwise(0.0)
    return cells.groupBy("column").agg(
        n.alias("n"), share(F.col("value").isNull()).alias("null_share"), share(F.coalesce(F.trim("value") == "", F.lit(False))).alias("blank_share")
    )


def value_counts(df: DataFrame, columns: list[str], most: int = MOST_COUNTED) -> DataFrame:
    """column, value, n: the most frequent values of each column, ties by value."""
    counted = stacked(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_last("value"))
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("rank")


def domains(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_values, complete, values: columns whose few short values cover nearly all rows.

    Only the most frequent values of each column leave the map side (the limit
    on the rank is pushed below the shuffle), so a column of billions of
    different values costs no task more than others; totals are a sum.
    """
    cells = stacked(df, columns)
    counted = cells.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    top = counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= MOST_VALUES + 1)
    kept = top.where(F.length("value") <= LONGEST_VALUE).groupBy("column").agg(
        F.count(F.lit(1)).alias("n_values"), F.sum("n").alias("covered"), F.sort_array(F.collect_list("value")).alias("values")
    )
    totals = cells.groupBy(F.col("column").alias("c")).agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("value").isNull().cast("long")).alias("n_null"))
    complete = (F.col("n_values") <= MOST_VALUES) & (F.col("covered") + F.col("n_null") >= LEAST_COVERAGE * F.col("total"))
    joined = kept.join(totals, kept["column"] == totals["c"])
    return joined.select("column", F.col("n_values").cast("long").alias("n_values"), complete.alias("complete"), F.when(complete, F.array_join("values", "|")).alias("values"))


def format_examples(df: DataFrame, columns: list[str], most: int = 3) -> DataFrame:
    """column, examples: the first, middle and last value of columns of codes and dates, whose values are too many to list.

    All values of such a column start with a digit and hold digits and ``:/-. T+``
    only. The values between are found by their rank among distinct values.
    """
    cells = stacked(df, columns).where(F.col("value").isNotNull())
    coded = cells.groupBy("column").agg(F.min(F.col("value").rlike(FORMAT)).alias("coded")).where("coded").select("column")
    distinct = cells.join(F.broadcast(coded), "column").distinct()  # as many rows as columns
    n = distinct.groupBy("column").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_VALUES)
    parts = distinct.repartitionByRange("column", "value").withColumn("part", F.spark_partition_id())
    sums = parts.groupBy("column", "part").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("column", "part", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("before"))
    inside = Window.partitionBy("column", "part").orderBy("value")
    ranked = parts.join(before, ["column", "part"]).join(F.broadcast(n), "column").withColumn("rank", F.col("before") + F.row_number().over(inside) - 1)
    wanted = F.array(*(F.round(F.lit(i) * (F.col("n") - 1) / F.lit(most - 1)).cast("long") for i in range(most)))
    picked = ranked.where(F.array_contains(wanted, F.col("rank")))
    return picked.groupBy("column").agg(F.array_join(F.sort_array(F.collect_list("value")), "|").alias("examples"))


def patterns(df: DataFrame, columns: list[str], most: int = 3) -> DataFrame:
    """column, pattern, n: the most frequent shapes of values that hold digits, digits as 9."""
    shaped = stacked(df, columns).where(F.col("value").rlike("[0-9]")).select("column", F.regexp_replace("value", "[0-9]", "9").alias("pattern"))
    counted = shaped.groupBy("column", "pattern").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column").orderBy(F.desc("n"), "pattern")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("rank")


def separators(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, separator, share: columns whose values are often lists."""
    cells = stacked(df, columns).where(F.col("value").isNotNull())
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("separator"), F.col("value").contains(s).alias("has")) for s in SEPARATORS)))
    per = cells.select("column", F.length("value").alias("len"), each.alias("x")).groupBy("column", "x.separator").agg(F.avg(F.col("x.has").cast("double")).alias("share"), F.percentile("len", F.lit(0.5)).alias("median"))
    found = per.where((F.col("share") >= LEAST_SEPARATED) & (F.col("median") <= LONGEST_LIST))
    return found.select("column", "separator", F.round("share", 2).alias("share"))


def eligible(df: DataFrame, keys: set[str]) -> list[str]:
    """Text columns that are neither keys nor, by their name, personal."""
    return [f.name for f in df.schema.fields if f.dataType.typeName() == "string" and f.name not in keys and not personal(f.name)]


def personal(name: str) -> bool:
    """Whether a column's name says that its values are personal or secret."""
    bare = re.sub(r"[\W_]+", "", name.lower())
    return any(w in bare for w in PERSONAL) or any(f"{w}name" in bare for w in WHOSE)


def unique_columns(df: DataFrame) -> DataFrame:
    """column, is_unique: columns without null whose values are all different."""
    cells = stacked(df, df.columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy("column").agg(F.max((F.col("n") > 1) | F.col("value").isNull()).alias("repeats")).select("column", (~F.col("repeats")).alias("is_unique"))


def has_duplicates(df: DataFrame, column: str) -> bool:
    """Whether some value that isn't null stands twice."""
    return not df.where(F.col(column).isNotNull()).groupBy(column).count().where("count > 1").limit(1).isEmpty()


def match_rate(source: DataFrame, column: str, target: DataFrame, target_column: str) -> DataFrame:
    """n, matched, rate: share of the source's values (all rows that aren't null) that the target stores."""
    values = source.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    keys = target.select(F.col(target_column).alias("k")).distinct()
    joined = values.join(keys, values["v"] == keys["k"], "left")
    return joined.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("k").isNotNull(), F.col("n"))), F.lit(0)).alias("matched")).select("n", "matched", F.round(F.col("matched") / F.col("n"), 4).alias("rate"))
