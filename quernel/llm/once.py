"""Records that arrived repeatedly count once."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each key: of rows that differ, the least by their other columns in order, whatever their order of arrival.

    Rows in which a key is null can't be told to be the same record and are all
    kept. Meant for results, which are smaller than the texts they are made of.
    """
    rest = [c for c in df.columns if c not in keys]
    unknown = functools.reduce(lambda a, b: a | b, (F.col(f"`{k}`").isNull() for k in keys))
    alone = F.when(unknown, F.monotonically_increasing_id()).otherwise(F.lit(-1)).alias("__alone")
    least = df.select(*(f"`{k}`" for k in keys), alone, F.struct(*(f"`{c}`" for c in rest)).alias("__x"))
    return least.groupBy(*(f"`{k}`" for k in keys), "__alone").agg(F.min("__x").alias("__x")).select(*(f"`{k}`" for k in keys), "__x.*")
