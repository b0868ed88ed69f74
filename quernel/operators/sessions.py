"""Grouping activity into sessions.

Time is divided into chunks no longer than the inactivity gap, so that all
events of one user inside one chunk belong to one session by definition. The
local session of a (user, chunk) is therefore a plain aggregate, combined on
the map side, and a hot user costs no more per task than any other. Adjacent
partial sessions of a user are then merged wherever the gap at their boundary
is below the threshold; a user has at most one partial session per chunk, so
what is sorted per user is bounded by the time span and not by the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone.

    One without zone is read in the session's zone, which should have no
    daylight saving; ``session.SETTINGS`` and clusters for this data say UTC.
    """
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), F.col(ts) if isinstance(ts, str) else ts)


def sessionize(
    df: DataFrame,
    user: str,
    ts: str,
    event_id: str,
    gap_minutes: float = 30.0,
    chunk_minutes: float = 15.0,
) -> DataFrame:
    """Sessions of each user, separated by more than ``gap_minutes``.

    Returns user, session_start, session_end, duration_s, n_events,
    first_event, last_event. Users are compared in lower case. Events at the
    same time are ordered by id. Rows equal in user, time and id count once.
    Events of a null user form the sessions of one null user; a null id is an
    event of its own time, ordered first; rows without a time belong to no session and give none. An
    empty input gives no rows. Other columns are ignored, whatever their names.

    ``chunk_minutes`` must not exceed ``gap_minutes``.
    """
    if not 0 < chunk_minutes <= gap_minutes:
        raise ValueError("chunk_minutes must be positive and at most gap_minutes")
    gap, chunk = int(gap_minutes * 60e6), int(chunk_minutes * 60e6)
    events = (
        df.select(
            F.lower(F.col(f"`{user}`")).alias("u"),
            micros(F.col(f"`{ts}`")).alias("t"),
            F.col(f"`{ts}`").alias("at"),
            F.col(f"`{event_id}`").alias("id"),
        )
        .where(F.col("t").isNotNull())
        .dropDuplicates(["u", "t", "id"])
        .withColumn("k", F.floor(F.col("t") / F.lit(chunk)))
    )
    order = F.struct("t", "id")
    partial = events.groupBy("u", "k").agg(
        F.min("t").alias("t0"),
        F.max("t").alias("t1"),
        F.min("at").alias("at0"),
        F.max("at").alias("at1"),
        F.count(F.lit(1)).alias("n"),
        F.min(order).alias("first"),
        F.max(order).alias("last"),
    )
    w = Window.partitionBy("u").orderBy("k")
    starts = F.when(F.col("t0") - F.lag("t1").over(w) <= F.lit(gap), 0).otherwise(1)
    merged = (
        partial.withColumn("starts", starts)
        .withColumn("s", F.sum("starts").over(w))
        .groupBy("u", "s")
        .agg(
            F.min("t0").alias("t0"),
            F.max("t1").alias("t1"),
            F.min("at0").alias("session_start"),
            F.max("at1").alias("session_end"),
            F.sum("n").alias("n_events"),
            F.min("first").alias("first"),
            F.max("last").alias("last"),
        )
    )
    return merged.select(
        F.col("u").alias(user),
        "session_start",
        "session_end",
        ((F.col("t1") - F.col("t0")) / F.lit(1e6)).alias("duration_s"),
        "n_events",
        F.col("first.id").alias("first_event"),
        F.col("last.id").alias("last_event"),
    )
