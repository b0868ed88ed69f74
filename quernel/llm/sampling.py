"""A bounded sample of texts for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

_BITS = 1 << 30


def bounded_sample(df: DataFrame, n: int) -> list[Row]:
    """At most ``n`` distinct rows of a frame without nulls, chosen and ordered by hash.

    The rows are thinned by their hash before any is sent, so that what reaches
    the driver is about ``n`` rows whatever the size of the frame. Repeated
    rows count once. The choice depends on the rows only, not on their order.
    """
    at = F.xxhash64(*df.columns)
    total, share = df.count(), 1.0
    kept = df.distinct()
    if total > 4 * n:
        share = 2.0 * n / total
        kept = _thinned(df, at, share)
        while share < 1.0 and kept.count() < n:  # many rows are copies
            share = min(1.0, share * 4)
            kept = _thinned(df, at, share)
    return kept.orderBy(at, *df.columns).limit(n).collect()


def _thinned(df: DataFrame, at: Column, share: float) -> DataFrame:
    return df.where(F.pmod(at, F.lit(_BITS)) < F.lit(int(share * _BITS))).distinct()
