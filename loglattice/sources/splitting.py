"""Records of CSV and JSON Lines files with their line numbers, from files that are read in splits.

A quoted CSV field may hold newlines, so whether a line begins a record depends on all lines before it. A line is a
function of one bit, whether a quote is open before it, to that bit after it: it leaves it, turns it, or sets it. Such
functions compose, so that each chunk of a split first composes its own, one row for each chunk then tells the bit at its
start, and within a chunk the last line that sets the bit and the turns since then tell the rest. No file is read by one
task, and a window spans the lines of a chunk, of which there are a bounded number, however large splits are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import stripped
from ..operators.ordering import chunk_of

#: Lines of a record at most: of more, as where a quote is never closed, each line is a record of its own, and rejected.
MOST_LINES = 10_000
#: Bytes of files whose lines one task sorts, about.
PART = 4_000_000
#: What tells chunks of lines apart.
CHUNK = ["FILENAME", "block", "chunk"]


def _same_chunk() -> Column:
    """How lines meet a table with one row, f, b and c, for each chunk."""
    return (F.col("FILENAME") == F.col("f")) & (F.col("block") == F.col("b")) & (F.col("chunk") == F.col("c"))


def parts_of(spark: SparkSession, paths: Sequence[str]) -> int:
    """Tasks to deal the files' lines to, by the files' lengths: short lines take many times their bytes in memory, and few when packed for a shuffle."""
    size = spark.read.format("binaryFile").load(list(paths)).agg(F.sum("length")).first()[0]
    return max(1, math.ceil((size or 0) / PART))


def placed_lines(spark: SparkSession, paths: Sequence[str], line_sep: str | None = None) -> DataFrame:
    """line, FILENAME, block (where the split begins), place (rising within a split)."""
    reader = spark.read if line_sep is None else spark.read.option("lineSep", line_sep)
    text = reader.text(list(paths))
    return text.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("FILENAME"), F.col("_metadata.file_block_start").alias("block")).withColumn("place", F.monotonically_increasing_id())


def _patterns(sep: str) -> tuple[str, str]:
    """Lines that leave no quote open: where none is before, and where one is. Quotes open fields at their start only."""
    other = f"[^\\x{{{ord(sep):x}}}]"
    inside = r'[^"]*+(?:""[^"]*+)*+"'
    field, s = f'(?:"{inside}{other}*+|(?!"){other}*+)', f"\\x{{{ord(sep):x}}}"
    return f"\\A{field}(?:{s}{field})*+\\z", f"\\A{inside}{other}*+(?:{s}{field})*+\\z"


def opened_by(line: Column, sep: str = ",") -> tuple[Column, Column]:
    """Whether a quote is open after the line, if none is open before it, and if one is."""
    from_outside, from_inside = _patterns(sep)
    plain = ~line.contains('"')
    return F.when(plain, False).otherwise(~line.rlike(from_outside)), F.when(plain, True).otherwise(~line.rlike(from_inside))


def _opening(spark: SparkSession, paths: Sequence[str], sep: str) -> DataFrame:
    """Whether a quote is open after each line that isn't blank, if none is open before it."""
    lines = spark.read.option("lineSep", "\n").text(list(paths)).where(stripped("value") != "")
    return lines.select(opened_by(F.regexp_replace("value", r"\r\z", ""), sep[:1])[0].alias("opens"))


def starts_with_open_quote(spark: SparkSession, paths: Sequence[str], sep: str = ",") -> bool:
    first = _opening(spark, paths, sep).first()
    return bool(first and first["opens"])


def has_open_quotes(spark: SparkSession, paths: Sequence[str], sep: str = ",") -> bool:
    """Whether any line of the files leaves a quote open: one pass that ends at the first such line."""
    return not _opening(spark, paths, sep).where("opens").isEmpty()


def csv_records(spark: SparkSession, paths: Sequence[str], sep: str = ",") -> DataFrame:
    """record, FILENAME, LINENUM of its first line; `whole`: false for what is no record, as no quote ends it; `is_head`: whether
    it is the file's first that isn't blank. Blank lines are numbered and left out."""
    lines, parts = placed_lines(spark, paths, "\n"), parts_of(spark, paths)
    bare = F.regexp_replace("line", r"\r\z", "")
    after_closed, after_open = opened_by(bare, sep)
    rows = lines.withColumns({"chunk": chunk_of("place"), "turns": after_closed & ~after_open, "sets": F.when(after_closed == after_open, after_closed)}).repartition(parts, *CHUNK)
    inside = Window.partitionBy(*CHUNK).orderBy("place")
    upto, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"n": F.row_number().over(inside), "turned": F.sum(F.col("turns").cast("long")).over(upto)})
    written = F.when(stripped("line") != "", F.col("n"))
    rows = rows.withColumn("first_of_chunk", (F.first(written, ignorenulls=True).over(upto) == F.col("n")) & written.isNotNull())
    rows = rows.withColumn("set_at", F.when(F.col("sets").isNotNull(), F.struct("n", F.col("sets").alias("bit"), "turned")))
    rows = rows.withColumn("last_set", F.last("set_at", ignorenulls=True).over(before)).withColumn("turned_before", F.col("turned") - F.col("turns").cast("long"))

    odd = lambda n: F.pmod(n, F.lit(2)) == 1
    chunks = rows.groupBy(*CHUNK).agg(F.max("n").alias("n"), F.max("turned").alias("turned"), F.max("set_at").alias("set_at"), F.max("first_of_chunk").alias("written"))
    chunks = chunks.withColumn("sets", F.when(F.col("set_at").isNotNull(), F.col("set_at.bit") != odd(F.col("turned") - F.col("set_at.turned")))).withColumn("turns", F.col("sets").isNull() & odd(F.col("turned")))
    over = Window.partitionBy("FILENAME").orderBy("block", "chunk")
    so_far = over.rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumns({"lines_before": F.coalesce(F.sum("n").over(so_far), F.lit(0)), "none_written": ~F.coalesce(F.max("written").over(so_far), F.lit(False)), "all_turns": F.sum(F.col("turns").cast("long")).over(over.rowsBetween(Window.unboundedPreceding, 0))})
    chunks = chunks.withColumn("last_set", F.last(F.when(F.col("sets").isNotNull(), F.struct(F.col("sets").alias("bit"), "all_turns")), ignorenulls=True).over(so_far))
    since = F.col("all_turns") - F.col("turns").cast("long") - F.coalesce(F.col("last_set.all_turns"), F.lit(0))
    starts = chunks.select(F.col("FILENAME").alias("f"), F.col("block").alias("b"), F.col("chunk").alias("c"), "lines_before", "none_written", (F.coalesce(F.col("last_set.bit"), F.lit(False)) != odd(since)).alias("open_at_start"))

    rows = rows.join(starts, _same_chunk())
    turned = odd(F.col("turned_before") - F.coalesce(F.col("last_set.turned"), F.lit(0)))
    is_open = F.coalesce(F.col("last_set.bit"), F.col("open_at_start")) != turned
    stays_open = F.coalesce(F.col("sets"), is_open != F.col("turns"))
    is_head = F.col("first_of_chunk") & (F.col("block") == 0) & F.col("none_written")
    told = rows.select("line", *CHUNK, "place", (F.col("lines_before") + F.col("n")).alias("LINENUM"), is_head.alias("is_head"), is_open.alias("is_open"), stays_open.alias("stays_open"))
    single = told.where("not is_open and not stays_open").select(F.regexp_replace("line", r"\r\z", "").alias("record"), "FILENAME", "LINENUM", F.lit(True).alias("whole"), "is_head").where(stripped("record") != "")
    return single.unionByName(_joined(told.where("is_open or stays_open"), parts))


def _joined(told: DataFrame, parts: int) -> DataFrame:
    """Records of several lines, from lines that begin, hold on to or end an open quote."""
    begins = F.when(~F.col("is_open"), F.col("LINENUM"))
    latest = told.groupBy(*CHUNK).agg(F.max(begins).alias("of_chunk"))
    carried = latest.select(F.col("FILENAME").alias("f"), F.col("block").alias("b"), F.col("chunk").alias("c"), F.max("of_chunk").over(Window.partitionBy("FILENAME").orderBy("block", "chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    own = F.max(begins).over(Window.partitionBy(*CHUNK).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    numbered = told.withColumn("own", own).join(carried, _same_chunk()).withColumn("first", F.coalesce("own", "carried"))
    far = F.col("LINENUM") - F.col("first") >= MOST_LINES
    lines = F.sort_array(F.collect_list(F.struct("LINENUM", "line", "stays_open", "is_head")))
    records = numbered.where(~far).repartition(parts, "FILENAME", "first").groupBy("FILENAME", "first").agg(lines.alias("parts"))
    whole = records.select(F.regexp_replace(F.array_join(F.transform("parts", lambda x: x["line"]), "\n"), r"\r\z", "").alias("record"), "FILENAME", F.col("first").alias("LINENUM"), (~F.element_at("parts", -1)["stays_open"]).alias("whole"), F.element_at("parts", 1)["is_head"].alias("is_head"))
    return whole.unionByName(numbered.where(far).select(F.col("line").alias("record"), "FILENAME", "LINENUM", F.lit(False).alias("whole"), F.lit(False).alias("is_head")))
