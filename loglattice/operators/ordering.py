"""Order-dependent operators at scale: line numbers, running totals, trailing frames.

A window over a whole file or table would be one task. Running totals are taken in slices of the order's range,
and each slice then starts from the sum of those before it; trailing frames are taken in blocks of row numbers,
each with a copy of the rows that precede it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slices of the order's range at most, and rows of one, about; rows of a block of trailing frames.
SLICES, SLICE_ROWS, BLOCK = 4096, 500_000, 65_536
#: Binary digits of the number of a split's lines that are taken at once, at most.
CHUNK_BITS = 14


def chunk_of(place: str) -> Column:
    """The chunk of a line, by its place from monotonically_increasing_id: rising within a split, and of a bounded number of lines."""
    return F.shiftright(place, CHUNK_BITS)


def number_lines(lines: DataFrame, parts: int) -> DataFrame:
    """lines (line, FILENAME, block, place) with LINENUM from 1 within each file: sums of chunks of blocks, then places within chunks.

    parts: tasks to deal the lines to.
    """
    chunk = ["FILENAME", "block", "chunk"]
    lines = lines.withColumn("chunk", chunk_of("place")).repartition(parts, *chunk)
    counts = lines.groupBy(*chunk).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(*chunk, (F.sum("n").over(Window.partitionBy("FILENAME").orderBy("block", "chunk")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*chunk).orderBy("place"))
    return lines.withColumn("inside", inside).join(before, chunk).select("line", "FILENAME", (F.col("before") + F.col("inside")).alias("LINENUM"))


def place_among(key: Column, cuts: list[float]) -> Column:
    """How many of the sorted cuts are under key, by looking at a few of them: first at every nth, then between two."""
    if not cuts:
        return F.lit(0)
    step = math.ceil(len(cuts) ** 0.5)
    parts = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    under = lambda some: F.size(F.filter(some, lambda c: c < key))
    array = lambda some: F.array(*[F.lit(float(c)) for c in some])
    part = under(array([p[-1] for p in parts]))
    fine = F.coalesce(F.get(F.array(*[array(p) for p in parts]), part), F.array().cast("array<double>"))
    return F.least(F.lit(len(cuts)), part * step + under(fine)) if len(parts) > 1 else under(array(cuts))


def position(df: DataFrame, column: str) -> Column:
    """A numeric or time column as a double; times in microseconds, of which those of our time are exact."""
    if dict(df.dtypes)[column] in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(F.col(f"`{column}`").cast("timestamp")).cast("double")
    return F.col(f"`{column}`").cast("double")


def slice_cuts(df: DataFrame, key: Column, slices: int | None = None) -> list[float]:
    """Values of key that cut df into slices of about equal numbers of rows: as many as these ask for, unless slices says so. One pass."""
    if slices == 1:
        return []
    steps = slices or 1024
    found, n = df.select(key.alias("k")).agg(F.percentile_approx("k", [i / steps for i in range(1, steps)], 20 * steps), F.count(F.lit(1))).first()
    wanted = slices or min(SLICES, steps, math.ceil(n / SLICE_ROWS))
    return sorted({found[steps * i // wanted - 1] for i in range(1, wanted)}) if found else []


def with_carried(rows: DataFrame, by: list[str], at: str, value: Column, name: str) -> DataFrame:
    """rows with the last value, an aggregate of slices (column `at`), that is not null in the slices before, within by.

    The window spans one row for each slice. Values of by are not null: structs of one column may hold one.
    """
    summed = rows.groupBy(*by, at).agg(value.alias("__summed"))
    before = F.last("__summed", ignorenulls=True).over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
    carried = summed.select(*[F.col(c).alias(f"__of_{i}") for i, c in enumerate(by)], F.col(at).alias("__of_at"), before.alias(name))
    same = F.col(at) == F.col("__of_at")
    for i, c in enumerate(by):
        same &= F.col(c) == F.col(f"__of_{i}")
    return rows.join(carried, same).drop("__of_at", *[f"__of_{i}" for i in range(len(by))])


def running_total(df: DataFrame, value: Column, name: str, order: str, by: list[str] | None = None, slices: int | None = None) -> DataFrame:
    """df with the running sum of value within by, in order of a numeric or time column whose values differ within by.

    There are as many slices as the number of rows asks for, unless slices says so.
    """
    by = by or []
    key = position(df, order)
    cuts = slice_cuts(df, key, slices)
    rows = df.withColumn("__slice", place_among(key, cuts)).withColumn("__value", value)
    sums = rows.groupBy(*by, "__slice").agg(F.sum("__value").alias("__sum"))
    before = sums.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__slice").alias("__at"), (F.coalesce(F.sum("__sum").over(Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("__before"))
    inside = F.coalesce(F.sum("__value").over(Window.partitionBy(*by, "__slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    same = F.col("__slice") == F.col("__at")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    summed = rows.withColumn("__inside", inside).join(before, same)
    return summed.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__before") + F.col("__inside")).alias(name))


def running_count(df: DataFrame, name: str, order: str, by: list[str] | None = None, when: Column | None = None) -> DataFrame:
    """df with the number of rows so far within by, or of those where when holds."""
    one = F.lit(1).cast("long") if when is None else F.when(when, 1).otherwise(0).cast("long")
    return running_total(df, one, name, order, by)


def trailing(df: DataFrame, n: int, order: str, columns: dict[str, callable], by: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """df with columns made over the last n rows, the current one included: name to a function from a window to a column.

    {"s": lambda w: F.sum("value").over(w)} and the like; functions that look back further than n - 1 rows find nothing.
    """
    if n < 1:
        raise ValueError("a window has one row at least")
    by = by or []
    block = max(block, n)
    rows = running_count(df, "__row", order, by)
    own = F.floor((F.col("__row") - 1) / block)
    ahead = F.pmod(F.col("__row") - 1, F.lit(block)) >= block - (n - 1)
    both = rows.withColumn("__at", own).withColumn("__block", F.explode(F.when(ahead, F.array(own, own + 1)).otherwise(F.array(own)))).withColumn("__own", F.col("__block") == F.col("__at"))
    ordered = Window.partitionBy(*by, "__block").orderBy("__row")
    for name, make in columns.items():
        if isinstance(make, back):
            both = both.withColumn(name, make(ordered) if make.k < n else F.lit(None).cast(dict(both.dtypes)[make.column]))
        else:
            both = both.withColumn(name, make(ordered.rowsBetween(1 - n, 0)))
    return both.where("__own").drop("__row", "__at", "__block", "__own")


def window_values(column: str) -> callable:
    """The column's texts within the frame, for trailing()."""
    return lambda w: F.collect_list(F.col(column).cast("string")).over(w)


def window_numbers(column: str) -> callable:
    """The column's numbers within the frame; what is no number is left out."""
    return lambda w: F.collect_list(F.col(column).try_cast("double")).over(w)


def window_size() -> callable:
    return lambda w: F.count(F.lit(1)).over(w)


@dataclass(frozen=True)
class back:  # noqa: N801  used like the functions beside it
    """The column k rows ago, where the frame reaches there: a lag within the block, which has the frame's rows before its own."""

    column: str
    k: int

    def __call__(self, block: Window) -> Column:
        return F.lag(self.column, self.k).over(block)


def until_exit(df: DataFrame, exit_when: Column, order: str, by: list[str] | None = None, message: Column | None = None, column: str = "line") -> DataFrame:
    """The rows of each by up to the first where exit_when holds; with message, that row's column is replaced by it."""
    by = by or ["__all"]
    rows = df.withColumn("__all", F.lit(0)) if by == ["__all"] else df
    stops = rows.where(exit_when).groupBy(*by).agg(F.min(order).alias("__stop")).select(*[F.col(c).alias(f"__by_{c}") for c in by], "__stop")
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    kept = rows.join(stops, same, "left").where(F.col("__stop").isNull() | (F.col(order) <= F.col("__stop")))
    if message is not None:
        kept = kept.withColumn(column, F.when(F.col(order) == F.col("__stop"), message).otherwise(F.col(column)))
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])
