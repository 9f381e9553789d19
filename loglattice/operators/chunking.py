"""Multi-line records from numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import stripped
from .ordering import running_count


def _joined(df: DataFrame, chunk: str, by: list[str], order: str, line: str) -> DataFrame:
    """chunk, start_line, n_lines, text for each chunk, its lines joined in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("l"))))
    return df.groupBy(*by, chunk).agg(F.min(order).alias("start_line"), F.count(F.lit(1)).alias("n_lines"), F.array_join(F.transform(parts, lambda x: x["l"]), "\n").alias("text"))


def chunk_lines(df: DataFrame, n: int, order: str = "LINENUM", line: str = "line", by: list[str] | None = None) -> DataFrame:
    """Chunks of n lines, the last one of what is left. order counts from 1 without gaps."""
    if n < 1:
        raise ValueError("a chunk has one line at least")
    return _joined(df.withColumn("chunk", F.floor((F.col(order) - 1) / n)), "chunk", by or [], order, line)


def chunk_start(df: DataFrame, pattern: str, order: str = "LINENUM", line: str = "line", by: list[str] | None = None) -> DataFrame:
    """A chunk starts at each line that the pattern matches; lines before the first are a chunk of their own."""
    numbered = running_count(df, "chunk", order, by, when=F.col(line).rlike(pattern))
    return _joined(numbered, "chunk", by or [], order, line)


def chunk_delimiter(df: DataFrame, delimiter: str, order: str = "LINENUM", line: str = "line", by: list[str] | None = None) -> DataFrame:
    """Chunks lie between lines equal to the delimiter but for white space around; those lines and empty chunks go."""
    ends = stripped(line) == delimiter.strip()
    numbered = running_count(df, "chunk", order, by, when=ends)
    return _joined(numbered.where(~ends), "chunk", by or [], order, line)


def chunked(df: DataFrame, lines: int | None = None, start: str | None = None, delimiter: str | None = None, **options) -> DataFrame:
    """By one strategy at most; without any, df itself."""
    given = [x for x in (lines, start, delimiter) if x is not None]
    if len(given) > 1:
        raise ValueError("lines, start and delimiter exclude each other")
    if lines is not None:
        return chunk_lines(df, lines, **options)
    if start is not None:
        return chunk_start(df, start, **options)
    return chunk_delimiter(df, delimiter, **options) if delimiter is not None else df
