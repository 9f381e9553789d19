"""Log levels: filters and the level map."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bound, first_of
from .ordering import running_count

# The names by which timestamps, levels and messages go, in order of precedence.
TIMESTAMP_KEYS = ["timestamp", "ts", "time", "t", "at", "_ts", "@t"]
LEVEL_KEYS = ["level", "loglevel", "log_level", "lvl", "severity", "levelname", "@l"]
MESSAGE_KEYS = ["message", "msg", "text", "m", "@m"]

# Words that stand for a level in a text, in order of precedence.
FAMILIES = {
    "error": ["error", "err", "fatal", "panic", "alert", "crit", "critical", "emerg", "emergency", "severe"],
    "warn": ["warn", "warning"],
    "info": ["info", "informational", "notice"],
    "debug": ["debug", "finer", "config"],
    "trace": ["trace", "finest"],
}


def family_regex(names: list[str]) -> str:
    """One of names between spaces, in brackets, before a colon, or at an end of the text."""
    any_of = "|".join(map(re.escape, names))
    return rf"(?: (?:{any_of}) |\[(?:{any_of})\]|(?:{any_of}):|\A(?:{any_of}) | (?:{any_of})\z)"


def level_from_text(text: Column | str) -> Column:
    """The level that a text names, by family; null without one."""


    def named(lower: Column) -> Column:
        found = F.lit(None).cast("string")
        for level, names in reversed(FAMILIES.items()):
            # plain searches first: the expression is only tried on texts that hold one of the names
            holds = reduce(lambda a, b: a | b, [lower.contains(n) for n in shortest(names)])
            found = F.when(holds & lower.rlike(family_regex(names)), level).otherwise(found)
        return found

    return bound(F.lower(F.col(text) if isinstance(text, str) else text), named)


def shortest(names: list[str]) -> list[str]:
    """Names that contain no other one."""
    return [n for n in names if not any(m != n and m in n for m in names)]


def level_of(df: DataFrame, level: str | None = None, text: str | None = None) -> Column:
    """The level in lower case: of the column named, of the first that goes by such a name, or of a text."""
    if text:
        return level_from_text(text)
    return F.lower(F.col(level).cast("string") if level else first_of(LEVEL_KEYS, df.columns))


def filter_levels(df: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, level: str | None = None, text: str | None = None) -> DataFrame:
    """Rows of the levels to include and not of those to exclude; without a level, kept unless some must be included."""
    found = level_of(df, level, text)
    if exclude:
        df = df.where(F.coalesce(~found.isin([x.lower() for x in exclude]), F.lit(True)))
    if include:
        df = df.where(F.coalesce(found.isin([x.lower() for x in include]), F.lit(False)))
    return df


#: A timestamp within a text.
TIMESTAMP = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"
#: Rows of the map that carry the last timestamp within one window.
CARRY = 4096


def level_map(df: DataFrame, order: str, width: int = 80, level: str | None = None, timestamp: str | None = None, text: str | None = None) -> DataFrame:
    """row, timestamp, map: the first letters of levels in order, width to a row, `.` for none; with the timestamp last
    seen when the row starts, of the column named, of the first that goes by such a name, or out of a text."""
    mark = F.coalesce(F.nullif(level_of(df, level, text).substr(1, 1), F.lit("")), F.lit("."))
    ts = F.col(timestamp).cast("string") if timestamp else F.regexp_substr(text, F.lit(TIMESTAMP)) if text else first_of(TIMESTAMP_KEYS, df.columns)
    rows = running_count(df.select(F.col(order), mark.alias("mark"), ts.alias("ts")), "n", order)
    rows = rows.withColumn("row", F.floor((F.col("n") - 1) / width))
    marks = F.array_sort(F.collect_list(F.struct("n", "mark")))
    own = F.min_by(F.struct("ts"), "n")["ts"].alias("own")
    made = rows.groupBy("row").agg(own, F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("n"))).alias("last"), F.array_join(F.transform(marks, lambda x: x["mark"]), "").alias("map")).withColumn("part", F.floor(F.col("row") / CARRY))
    ends = made.groupBy("part").agg(F.max_by("last", F.when(F.col("last").isNotNull(), F.col("row"))).alias("end"))
    before = lambda name, w: F.last(name, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select(F.col("part").alias("of"), before("end", Window.orderBy("part")).alias("carried"))
    within = before("last", Window.partitionBy("part").orderBy("row"))
    return made.withColumn("within", within).join(carried, F.col("part") == F.col("of")).select("row", F.coalesce("own", "within", "carried").alias("timestamp"), "map")
