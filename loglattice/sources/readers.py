"""Readers of log and table formats. Lines that a format doesn't take are told apart by `rejected`, never lost."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from pathlib import PurePath

from pyspark.sql import Column, DataFrame, DataFrameReader, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.columns import bound, stripped, words
from ..operators.ordering import number_lines
from .splitting import csv_records, has_open_quotes, parts_of, placed_lines, starts_with_open_quote

FORMATS = ("line", "jsonl", "csv", "tsv", "logfmt", "syslog", "combined", "fields", "parquet", "orc")
# File endings that name a format.
ENDINGS = {".jsonl": "jsonl", ".csv": "csv", ".tsv": "tsv", ".logfmt": "logfmt", ".parquet": "parquet", ".orc": "orc"}

# The line formats of syslog (RFC 5424, RFC 3164) and access logs (extended, combined, common).
RFC5424 = r"^<(\d{1,3})>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)(?:\s+(.*))?$"
RFC3164 = r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^:\[\s]+)(?:\[(\d+)\])?\s*:\s*(.*)$"
EXTENDED = r'^(\S+)\s+(\S+)\s+-\s+(\S+)\s+(\d+)\s+\[([^\]]+)\]\s+"([^"]*)"\s+"([^"]*)"\s+(\d+)\s+(\S+)\s+"([^"]*)"\s+"([^"]*)"(?:\s+(.*))?$'
COMBINED = r'^(\S+)\s+-\s+(\S+)\s+\[([^\]]+)\]\s+"([^"]*)"\s+(\d+)\s+(\S+)\s+"([^"]*)"\s+"([^"]*)"$'
COMMON = r'^(\S+)\s+-\s+(\S+)\s+\[([^\]]+)\]\s+"([^"]*)"\s+(\d+)\s+(\S+)$'
#: A logfmt pair: a value is quoted, up to the end where the quote isn't closed, or goes up to a blank.
PAIR = r'[ \t]*([^ \t=]+)=("(?:[^"\\]|\\(?s:.)|"")*+(?:"|\\?\z)|[^ \t"][^ \t]*|)'
#: Keys that a file may have before columns are made of them.
MOST_KEYS = 10_000


def format_of(paths: Sequence[str], fmt: str | None = None) -> str:
    """The format given, or what the first path's ending names; line otherwise."""
    if fmt:
        if fmt not in FORMATS:
            raise ValueError(f"{fmt!r} is no format; there are {', '.join(FORMATS)}")
        return fmt
    return ENDINGS.get(PurePath(paths[0]).suffix.lower(), "line") if paths else "line"


def read_lines(spark: SparkSession, paths: str | Sequence[str], keep_blank: bool = False) -> DataFrame:
    """line, FILENAME, LINENUM. Blank lines are numbered and then left out."""
    paths = [paths] if isinstance(paths, str) else paths
    lines = number_lines(placed_lines(spark, paths), parts_of(spark, paths))
    return lines if keep_blank else lines.where(stripped("line") != "")


def read(spark: SparkSession, paths: str | Sequence[str], fmt: str | None = None, seen: Observation | None = None, **options) -> DataFrame:
    """Records of files. errors: `skip`, `keep` (rejected lines in a column `rejected`) or `fail`; keep_blank: blank lines, which chunks need.

    numbered: with LINENUM and FILENAME, which line formats always have; a record's own columns of these names stay instead.
    Quoted CSV and TSV fields may hold newlines; where some do, or lines are numbered, records are put together over splits,
    else Spark reads them as they are. multiline=True reads each file as a whole, in one task; multiline=False takes each line for
    a record. seen counts `read` and `errors` once the records are written or collected.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    kind, errors, keep_blank, numbered = format_of(paths, fmt), options.pop("errors", "skip"), options.pop("keep_blank", False), options.pop("numbered", False)
    if kind in ("parquet", "orc"):
        return spark.read.format(kind).load(paths)
    if kind in ("csv", "tsv"):
        multiline = options.pop("multiline", None)
        options = {"header": True, "escape": '"', "sep": "\t" if kind == "tsv" else ",", "enforceSchema": False, **options}
        columns = spark.read.options(**options, multiLine=bool(multiline) or starts_with_open_quote(spark, paths, options["sep"])).csv(paths).schema
        splits = len(options["sep"]) == 1 and options["escape"] == '"' and multiline is None
        if splits and (numbered or has_open_quotes(spark, paths, options["sep"])):
            return _csv_in_splits(spark, paths, columns, options, errors, seen, numbered)
        return _told_apart(spark.read.options(**options, multiLine=bool(multiline)).schema(_with_rejected(columns)), "csv", paths, errors, seen)
    if kind == "jsonl":
        columns = StructType([f for f in spark.read.options(columnNameOfCorruptRecord="rejected", **options).json(paths).schema if f.name != "rejected"])
        if not numbered:
            return _told_apart(spark.read.options(**options).schema(_with_rejected(columns)), "json", paths, errors, seen)
        lines = read_lines(spark, paths)
        record = F.from_json("line", _with_rejected(columns), _mode(errors) | options)
        return _numbered(lines.withColumn("__record", record), columns, errors, seen, numbered)
    return parse(read_lines(spark, paths, keep_blank), kind, errors=errors, seen=seen)


def _with_rejected(columns: StructType) -> StructType:
    return StructType([*columns, StructField("rejected", StringType())])


def _mode(errors: str) -> dict[str, str]:
    return {"mode": "FAILFAST" if errors == "fail" else "PERMISSIVE", "columnNameOfCorruptRecord": "rejected"}


def _csv_in_splits(spark: SparkSession, paths: list[str], columns: StructType, options: dict, errors: str, seen: Observation | None, numbered: bool) -> DataFrame:
    """Records of CSV files that are read in splits. A file's first record is its header, which must be that of the others."""
    header = str(options["header"]).lower() == "true"
    parsing = {k: str(v) for k, v in options.items() if k not in ("header", "enforceSchema")} | _mode(errors)
    records = csv_records(spark, paths, options["sep"])
    if header:
        differs = F.raise_error(F.concat(F.lit("another header than the first file's: "), F.col("record"))).cast("boolean")
        records = records.where(F.when(F.col("is_head"), F.when(_header(columns, parsing), False).otherwise(differs)).otherwise(True))
    broken = F.when(~F.col("whole"), F.col("record"))
    if errors == "fail":
        broken = F.when(~F.col("whole"), F.raise_error(F.concat(F.lit("a quote is never closed: "), F.col("record"))))
    schema = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in _with_rejected(columns))
    rows = records.withColumn("__record", F.from_csv("record", schema, parsing)).withColumn("__broken", broken)
    return _numbered(rows, columns, errors, seen, numbered)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _header(columns: StructType, parsing: dict[str, str]) -> Column:
    """Whether a record consists of the columns' names."""
    texts = F.from_csv("record", ", ".join(f"c{i} string" for i in range(len(columns))), {k: v for k, v in parsing.items() if k not in ("mode", "columnNameOfCorruptRecord")})
    same = F.lit(True)
    for i, f in enumerate(columns):
        same &= F.coalesce(texts[f"c{i}"], F.lit(f"_c{i}")) == f.name
    return same


def _numbered(rows: DataFrame, columns: StructType, errors: str, seen: Observation | None, numbered: bool) -> DataFrame:
    """rows' __record as columns, with LINENUM and FILENAME where they are wanted; and __broken, what is rejected in any case."""
    own = [c for c in ("FILENAME", "LINENUM") if numbered and c not in columns.names]
    broken = F.col("__broken") if "__broken" in rows.columns else F.lit(None).cast("string")
    fields = [F.when(broken.isNull(), F.col("__record")[f.name]).alias(f.name) for f in columns]
    made = rows.select(*own, *fields, F.coalesce(broken, F.col("__record")["rejected"]).alias("rejected"))
    return _kept(made, F.col("rejected").isNotNull(), errors, seen)


def _told_apart(reader: DataFrameReader, kind: str, paths: list[str], errors: str, seen: Observation | None) -> DataFrame:
    df = reader.options(mode="FAILFAST" if errors == "fail" else "PERMISSIVE", columnNameOfCorruptRecord="rejected").format(kind).load(paths)
    # Spark wants another column than this one read along; every hash is in range
    first = [F.hash(f"`{c}`") >= -(1 << 31) for c in df.columns[:1] if c != "rejected"]
    return _kept(df, reduce(lambda a, b: a & b, first, F.col("rejected").isNotNull()), errors, seen)


def _kept(df: DataFrame, bad: Column, errors: str, seen: Observation | None) -> DataFrame:
    """df without the rejected records, unless they are to be kept; with what seen counts."""
    if seen is not None:
        df = df.observe(seen, F.count(F.lit(1)).alias("read"), F.count_if(bad).alias("errors"))
    return df if errors == "keep" else df.where(~bad).drop("rejected")


def parse(df: DataFrame, kind: str, line: str = "line", errors: str = "skip", width: int | None = None, seen: Observation | None = None) -> DataFrame:
    """df's lines in a line format as columns: rejected lines skipped, or kept with a column `rejected`, or raised."""
    if kind in ("line", "fields"):
        df = df if seen is None else df.observe(seen, F.count(F.lit(1)).alias("read"), F.lit(0).alias("errors"))
        return df if kind == "line" else _fields(df, line, width)
    made = {"logfmt": logfmt, "syslog": syslog, "combined": access_log, "jsonl": json_map}[kind]
    parsed = df.withColumn("__record", bound(stripped(line), made))
    bad = F.col("__record").isNull()
    if errors == "fail":
        parsed = parsed.withColumn("__record", F.when(bad, F.raise_error(F.concat(F.lit(f"not {kind}: "), F.col(line)))).otherwise(F.col("__record")))
    parsed = _kept(parsed, bad, errors, seen)
    if errors == "keep":
        parsed = parsed.withColumn("rejected", F.when(bad, F.col(line)))
    if kind in ("logfmt", "jsonl"):
        return parsed.withColumnRenamed("__record", "record")
    rest = [c for c in parsed.columns if c not in ("__record", line)]
    return parsed.select(*rest, "__record.*")


def json_map(line: Column) -> Column:
    """The top level of a JSON object, values as JSON text, in order; null for bad JSON."""
    return F.when(F.try_parse_json(line).isNotNull(), F.from_json(line, "map<string,string>"))


def logfmt(line: Column) -> Column:
    """A map of the pairs; null where a word has no `=`. Quoted values may hold escapes; the last of equal keys counts."""

    def record(pairs: Column) -> Column:
        names = F.transform(pairs, lambda x: F.substring_index(F.ltrim(x, F.lit(" \t")), "=", 1))
        values = F.transform(pairs, lambda x: _unquoted(x.substr(F.instr(x, "=") + 1, F.length(x))))
        return bound(F.struct(names.alias("names"), values.alias("values")), _last_of_each)

    whole = F.regexp_replace(line, PAIR, "") == ""
    return F.when(whole & (line != ""), bound(F.regexp_extract_all(line, F.lit(PAIR), F.lit(0)), record))


def _last_of_each(pairs: Column) -> Column:
    names, values = pairs["names"], pairs["values"]
    entries = F.arrays_zip(names.alias("k"), values.alias("v"))
    last = F.filter(entries, lambda x, i: ~F.array_contains(F.slice(names, i + 2, F.size(names) + 1), x["k"]))
    return F.when(F.size(F.array_distinct(names)) == F.size(names), F.map_from_arrays(names, values)).otherwise(F.map_from_entries(last))


def _unquoted(value: Column) -> Column:
    """What a quoted value means: parts between escapes and doubled quotes, and these one by one."""
    inner = F.regexp_extract(value, r'(?s)\A"((?:[^"\\]|\\.|"")*+\\?)', 1)
    parts = F.regexp_extract_all(inner, F.lit(r'(?s)\\.|""|[^\\"]+'), F.lit(0))
    meant = lambda p: F.when(p == "\\n", "\n").when(p == "\\t", "\t").when(p == "\\r", "\r").when(p == "\\\\", "\\").when((p == '\\"') | (p == '""'), '"').otherwise(p)
    plain = ~inner.contains("\\") & ~inner.contains('""')
    return F.when(~value.startswith('"'), value).when(plain, inner).otherwise(F.array_join(F.transform(parts, meant), ""))


#: Stands between a match's groups; lines that hold it are matched group by group.
BETWEEN = "\x01"


def _groups(line: Column, pattern: str, n: int) -> Column:
    """The n groups of a pattern for whole lines, by one match; null for other lines."""
    at_once = F.split(F.regexp_replace(line, pattern, BETWEEN.join(f"${i}" for i in range(1, n + 1))), BETWEEN)
    one_by_one = F.array(*[F.regexp_extract(line, pattern, i) for i in range(1, n + 1)])
    return F.when(line.rlike(pattern), F.when(line.contains(BETWEEN), one_by_one).otherwise(at_once))


def _given(value: Column) -> Column:
    return F.nullif(F.nullif(value, F.lit("-")), F.lit(""))


def syslog(line: Column) -> Column:
    """pri, facility, severity, ts, host, prog, pid, msgid, msg; null for other lines and priorities over 191."""

    def record(found: Column) -> Column:
        new, old = found["new"], found["old"]
        pri = new[0].try_cast("bigint")
        either = lambda i, j: F.when(new.isNotNull(), new[i]).otherwise(old[j])
        made = F.struct(
            pri.alias("pri"), F.shiftright(pri, 3).alias("facility"), pri.bitwiseAND(F.lit(7)).alias("severity"), either(2, 0).alias("ts"), either(3, 1).alias("host"),
            _given(either(4, 2)).alias("prog"), _given(either(5, 3)).try_cast("bigint").alias("pid"), _given(new[6]).alias("msgid"), either(8, 4).alias("msg"),
        )
        return F.when((pri <= 191) | (new.isNull() & old.isNotNull()), made)

    return bound(_groups(line, RFC5424, 9), lambda new: bound(F.struct(new.alias("new"), F.when(new.isNull(), _groups(line, RFC3164, 5)).alias("old")), record))


# What the groups of each kind of access log are.
ACCESS_LOGS = (
    (EXTENDED, ("ip", "host", "user", "port", "ts", "req", "query", "status", "size", "referer", "ua", "timing")),
    (COMBINED, ("ip", "user", "ts", "req", "status", "size", "referer", "ua")),
    (COMMON, ("ip", "user", "ts", "req", "status", "size")),
)


def access_log(line: Column) -> Column:
    """ip, host, user, port, ts, req, query, method, path, proto, status, size, referer, ua, timing: what the line has of them."""
    extended, combined, common = (_groups(line, pattern, len(names)) for pattern, names in ACCESS_LOGS)

    def record(found: Column) -> Column:
        def field(name: str) -> Column:
            of = [found[f"k{k}"][names.index(name)] for k, (_, names) in enumerate(ACCESS_LOGS) if name in names]
            return F.coalesce(*of)

        part = F.split(field("req"), " ", 3)
        number = lambda name: _given(field(name)).try_cast("bigint").alias(name)
        made = F.struct(
            field("ip").alias("ip"), _given(field("host")).alias("host"), _given(field("user")).alias("user"), number("port"), field("ts").alias("ts"), field("req").alias("req"), _given(field("query")).alias("query"),
            F.get(part, F.lit(0)).alias("method"), F.get(part, F.lit(1)).alias("path"), F.get(part, F.lit(2)).alias("proto"), number("status"), number("size"), _given(field("referer")).alias("referer"), _given(field("ua")).alias("ua"), _given(field("timing")).alias("timing"),
        )
        return F.when(F.coalesce(found["k0"], found["k1"], found["k2"]).isNotNull(), made)

    # each kind is tried on lines that those before didn't take, and once
    then = lambda a, b: bound(F.when(b.isNull() & a.isNull(), common), lambda c: record_of(a, b, c))
    record_of = lambda a, b, c: bound(F.struct(a.alias("k0"), b.alias("k1"), c.alias("k2")), record)
    return bound(extended, lambda a: bound(F.when(a.isNull(), combined), lambda b: then(a, b)))


def _fields(df: DataFrame, line: str, width: int | None) -> DataFrame:
    """f1, f2, ... between white space; as many as the widest line has, which one pass finds out unless width says so."""
    parts = words(line)
    if width is None:
        width = df.agg(F.max(F.size(parts))).first()[0] or 0
    split = df.withColumn("__parts", parts)
    rest = [c for c in df.columns if c != line]
    return split.select(*rest, *[F.get("__parts", F.lit(i)).alias(f"f{i + 1}") for i in range(width)])


def as_columns(df: DataFrame, record: str = "record", names: list[str] | None = None) -> DataFrame:
    """A map column's keys as columns; one pass finds out the keys, in order of their first appearance, unless names gives them."""
    if names is None:
        keys = df.select(F.posexplode(F.map_keys(record)).alias("at", "k"), F.monotonically_increasing_id().alias("row"))
        names = [r.k for r in keys.groupBy("k").agg(F.min(F.struct("row", "at")).alias("first")).orderBy("first").limit(MOST_KEYS + 1).collect()]
        if len(names) > MOST_KEYS:
            raise ValueError(f"more than {MOST_KEYS} different keys: say which ones are columns")
    rest = [c for c in df.columns if c != record]
    return df.select(*rest, *[F.try_element_at(record, F.lit(n)).alias(n) for n in names if n not in rest])
