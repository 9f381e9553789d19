"""Lines of the output formats, and sinks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ..operators.levels import FAMILIES, level_of
from ..operators.records import flatten
from ..session import stored

LINES = ("line", "jsonl", "csv", "tsv", "logfmt", "plain", "fields")

# Terminal colours of level families.
COLOURS = {"error": "31", "warn": "33", "info": "32", "debug": "36", "trace": "90"}


def _text(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    return F.to_json(c) if isinstance(kind, ArrayType | MapType | StructType) else c.cast("string")


def logfmt_line(df: DataFrame) -> Column:
    """key=value pairs; values with blanks, quotes or `=`, and empty ones, are quoted; null is left empty."""
    parts = []
    for name in df.columns:
        value = _text(df, name)
        quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('\\"')), F.lit('"'))
        parts.append(F.concat(F.lit(f"{name}="), F.when(value.isNull(), "").when((value == "") | value.rlike('[ \t\n"=]'), quoted).otherwise(value)))
    return F.concat_ws(" ", *parts)


def plain_line(df: DataFrame) -> Column:
    return F.concat_ws(" ", *[F.coalesce(_text(df, n), F.lit("")) for n in df.columns])


def fields_line(df: DataFrame) -> Column:
    """Values between spaces; nulls are left out."""
    return F.concat_ws(" ", *[_text(df, n) for n in df.columns])


def csv_line(df: DataFrame, sep: str = ",") -> Column:
    """Values between separators, quoted where they hold one, a quote or a newline; null is empty."""
    parts = []
    for name in df.columns:
        value = F.coalesce(_text(df, name), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
        parts.append(F.when(value.contains(sep) | value.contains('"') | value.contains("\n"), quoted).otherwise(value))
    return F.concat_ws(sep, *parts)


def json_line(df: DataFrame, keep_nulls: bool = False) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": str(not keep_nulls).lower()})


def coloured(line: Column, level: Column) -> Column:
    """The line in its level's colour, by ANSI codes."""
    code = F.lit(None).cast("string")
    for name, c in COLOURS.items():
        code = F.when(level == name, c).otherwise(code)
    return F.when(code.isNull(), line).otherwise(F.concat(F.lit("\u001b["), code, F.lit("m"), line, F.lit("\u001b[0m")))


def family_of(level: Column) -> Column:
    """The family of a level's name, in any case."""
    found = F.lit(None).cast("string")
    for family, names in FAMILIES.items():
        found = F.when(F.lower(level).isin(names), family).otherwise(found)
    return found


def line_of(df: DataFrame, fmt: str = "logfmt", colours: bool = False) -> Column:
    """df's rows as lines, of columns by name. colours: line, logfmt and plain in those of their levels, by a level's column or
    out of the text. Nested values must be flat for csv, tsv and fields."""
    if colours and fmt not in ("line", "logfmt", "plain"):
        raise ValueError("only line, logfmt and plain have colours")
    if fmt == "line" and df.columns != ["line"]:
        raise ValueError("only text can be written as lines; choose another format for columns")
    if fmt not in LINES:
        raise ValueError(f"{fmt!r} is no line format; there are {', '.join(LINES)}")
    line = F.col("line") if fmt == "line" else _line(df, fmt)
    return coloured(line, family_of(level_of(df, text="line" if df.columns == ["line"] else None))) if colours else line


def formatted(df: DataFrame, fmt: str = "logfmt", colours: bool = False) -> DataFrame:
    """One column, line: line_of() of df, whose nested values are flattened for csv, tsv and fields."""
    if fmt in ("csv", "tsv", "fields"):
        df = flatten(df)
    return df.select(line_of(df, fmt, colours).alias("line"))


def _line(df: DataFrame, fmt: str) -> Column:
    make = {"jsonl": json_line, "csv": csv_line, "tsv": lambda d: csv_line(d, "\t"), "logfmt": logfmt_line, "plain": plain_line, "fields": fields_line}[fmt]
    return make(df)


@dataclass(frozen=True)
class RunResult:
    """What a run did: rows written, errors, records read where that is known, and an exit code (1: errors, 2: no output, 0: output)."""

    rows: int
    errors: int = 0
    code: int | None = None
    read: int | None = None
    #: counts by step and what was seen, where a pipeline was asked for them
    report: object | None = None

    @property
    def skipped(self) -> int | None:
        """Records that were read and neither written nor wrong; fan-out may have written more."""
        return None if self.read is None else max(0, self.read - self.errors - self.rows)

    @property
    def exit_code(self) -> int:
        return self.code or (1 if self.errors else 0 if self.rows else 2)


def in_order(df: DataFrame, order: list[str]) -> DataFrame:
    """df in ranges of order, each sorted: the files that are written of it, in order of their names, hold it in order.

    Nulls come first. Spark samples df to find the ranges, so that it is evaluated twice. Rows of equal order may come in any; names of files sort as numbers do up to 100,000 of them.
    """
    columns = [F.col(f"`{c}`").asc_nulls_first() for c in order]
    return df.repartitionByRange(*columns).sortWithinPartitions(*columns)


def write(df: DataFrame, path: str, fmt: str = "logfmt", mode: str = "error", errors: int = 0, colours: bool = False, order: list[str] | None = None, drop: list[str] | None = None) -> RunResult:
    """Writes df as files of a folder; csv and tsv files have a header each. Rows are counted as they are written.

    order: columns by which the rows are put in order over all files, by name; csv and tsv then have one header, which
    begins the first file, so that the files make one text. drop: columns of order that aren't written.
    """
    count = Observation()
    if order and fmt == "parquet":
        with stored(df.observe(count, F.count(F.lit(1)).alias("rows")), "in-order") as rows:
            in_order(rows, order).drop(*(drop or [])).write.mode(mode).parquet(path)
        return RunResult(count.get["rows"], errors)
    if order:
        return _write_lines_in_order(df, path, fmt, mode, errors, colours, order, drop or [], count)
    if fmt in ("csv", "tsv"):
        df = flatten(df)
    elif fmt != "parquet":
        df = formatted(df, fmt, colours)
    writer = df.observe(count, F.count(F.lit(1)).alias("rows")).write.mode(mode)
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt in ("csv", "tsv"):
        writer.options(header=True, sep="\t" if fmt == "tsv" else ",", escape='"').csv(path)
    else:
        writer.text(path)
    return RunResult(count.get["rows"], errors)


def _write_lines_in_order(df: DataFrame, path: str, fmt: str, mode: str, errors: int, colours: bool, order: list[str], drop: list[str], count: Observation) -> RunResult:
    keys = [f"__o{i}" for i in range(len(order))]
    keyed = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(order, keys, strict=True)], *[F.col(f"`{c}`") for c in df.columns if c not in drop])
    if fmt in ("csv", "tsv", "fields"):
        keyed = flatten(keyed)
    shown = keyed.drop(*keys)
    lines = keyed.select(F.lit(1).alias("__part"), *keys, line_of(shown, fmt, colours).alias("line")).observe(count, F.count(F.lit(1)).alias("rows"))
    if fmt in ("csv", "tsv"):
        names = df.sparkSession.createDataFrame([tuple(shown.columns)], [f"c{i}" for i in range(len(shown.columns))])
        lines = lines.unionByName(names.select(F.lit(0).alias("__part"), csv_line(names, "\t" if fmt == "tsv" else ",").alias("line")), allowMissingColumns=True)
    with stored(lines, "in-order") as rows:
        in_order(rows, ["__part", *keys]).select("line").write.mode(mode).text(path)
    return RunResult(count.get["rows"], errors)
