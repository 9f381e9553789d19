"""Sessions of stored rows: rows of a key go together while no gap parts them. DataFrame functions only.

A window over a key would be one task for a key with most of the rows. Here the time range is cut in slices; a slice
knows the last time before it, from which it tells whether its first row goes on with a session, and the last session
that began before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import place_among, position, slice_cuts, with_carried


def sessionize(df: DataFrame, time: str, gap: float, by: Sequence[str] = (), start: str = "session_start", number: str = "session_no", slices: int | None = None) -> DataFrame:
    """df with the time at which each row's session began, and the session's number within by, from 1.

    A session ends where the next row is more than gap later: in seconds for times, in units for numbers. Nulls in by
    are a group of their own; rows without a time are in no session.
    """
    if gap < 0:
        raise ValueError("a gap isn't negative")
    kind = dict(df.dtypes)[time]
    timed = kind in ("timestamp", "timestamp_ntz", "date")
    by, at = list(by), position(df, time)
    keys = [f"__k{i}" for i in range(len(by))]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), F.when(~F.isnan(at), at).alias("__at"), *[F.struct(F.col(f"`{c}`").alias("v")).alias(k) for c, k in zip(by, keys, strict=True)])
    cuts = slice_cuts(rows, F.col("__at"), slices)
    rows = rows.withColumn("__slice", F.coalesce(place_among(F.col("__at"), cuts), F.lit(-1)))
    rows = with_carried(rows, keys, "__slice", F.max("__at"), "__last")
    window = Window.partitionBy(*keys, "__slice").orderBy("__at")
    before = F.coalesce(F.lag("__at").over(window), F.col("__last"))
    later = F.col("__at") - before > (gap * 1e6 if timed else gap)
    rows = rows.withColumn("__begins", F.when(F.col("__at").isNotNull() & (before.isNull() | later), F.col("__at")))
    # rows of one time are peers: they count the same sessions, whichever of them comes first
    upto = window.rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"__start": F.max("__begins").over(upto), "__n": F.count("__begins").over(upto)})
    rows = with_carried(rows, keys, "__slice", F.max("__begins"), "__carried")
    rows = _with_counts_before(rows, keys)
    began = F.coalesce(F.col("__start"), F.col("__carried"))
    began = F.timestamp_micros(began.cast("long")) if timed else began
    inside = F.col("__at").isNotNull()
    return rows.select("__row.*", F.when(inside, began.cast(kind)).alias(start), F.when(inside, F.col("__before") + F.col("__n")).cast("long").alias(number))


def _with_counts_before(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the number of sessions that began in slices before: counts of slices, summed up."""
    counts = rows.groupBy(*keys, "__slice").agg(F.count("__begins").alias("__c"))
    summed = counts.select(*[F.col(k).alias(f"__of{k}") for k in keys], F.col("__slice").alias("__of_slice"), F.coalesce(F.sum("__c").over(Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    same = F.col("__slice") == F.col("__of_slice")
    for k in keys:
        same &= F.col(k) == F.col(f"__of{k}")
    return rows.join(summed, same)


def sessions(df: DataFrame, time: str, gap: float, by: Sequence[str] = (), slices: int | None = None, **aggregates: Column) -> DataFrame:
    """A row for each session: by, session_no, session_start, session_end (its last row's time), n, and aggregates."""
    marked = sessionize(df, time, gap, by, slices=slices).where(F.col("session_start").isNotNull())
    return marked.groupBy(*by, "session_no", "session_start").agg(F.max(time).alias("session_end"), F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in aggregates.items()])
