"""Record operators: templates, fan-out, projections, flattening, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ..functions.columns import first_of
from ..functions.patterns import template
from .levels import LEVEL_KEYS, MESSAGE_KEYS, TIMESTAMP_KEYS


#: Keys of a map that may become columns.
MOST_KEYS = 10_000


def extract_vars(df: DataFrame, text: str, line: str = "line") -> DataFrame:
    """df with a column for each field of the template, from the first match in line; null where it doesn't match, or a
    number is too large: then the record goes on as it is, with its line."""
    pattern, fields = template(text)
    match = F.col(line).rlike(pattern)
    got = {name: F.when(match, F.regexp_extract(line, pattern, i + 1).try_cast(kind)) for i, (name, kind) in enumerate(fields)}
    whole = match
    for i, (_, kind) in enumerate(fields):
        if kind == "bigint":
            whole &= F.regexp_extract(line, pattern, i + 1).try_cast("bigint").isNotNull()
    return df.withColumns({name: F.when(whole, c) for name, c in got.items()})


def emit(df: DataFrame, emissions: Column, line: str = "line", primary: bool = True) -> DataFrame:
    """A row for the record, unless skipped, and one for each text of emissions, in that order of `emission` (0: the record)."""
    texts = F.concat(F.array(F.col(line)), F.coalesce(emissions, F.array().cast("array<string>"))) if primary else F.concat(F.array(F.lit(None).cast("string")), emissions)
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns if c != line], F.posexplode(texts).alias("emission", line))
    return rows if primary else rows.where("emission > 0")


def keys(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns named, in that order; names that don't exist are left out."""
    return df.select(*[F.col(f"`{n}`") for n in names if n in df.columns])


def remove_keys(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def common_keys(df: DataFrame, more: list[str] | None = None) -> DataFrame:
    """Timestamp, level and message columns, by any of their names, then those in more."""
    return keys(df, list(dict.fromkeys([*TIMESTAMP_KEYS, *LEVEL_KEYS, *MESSAGE_KEYS, *(more or [])])))


def flatten(df: DataFrame, widths: dict[str, int] | None = None) -> DataFrame:
    """Nested fields as columns with dotted names, list items by place. Lists' lengths are looked up once, where widths doesn't give them."""

    def leaves(path: str, column: Column, kind) -> list[tuple[str, Column]]:
        if isinstance(kind, StructType):
            return [x for f in kind.fields for x in leaves(f"{path}.{f.name}" if path else f.name, column.getField(f.name) if path else F.col(f"`{f.name}`"), f.dataType)]
        if isinstance(kind, ArrayType):
            wide = (widths or {}).get(path)
            if wide is None:
                wide = df.agg(F.max(F.size(column))).first()[0] or 0
            return [x for i in range(wide) for x in leaves(f"{path}.{i}", F.get(column, F.lit(i)), kind.elementType)]
        if isinstance(kind, MapType):
            names = [r[0] for r in df.select(F.explode(F.map_keys(column)).alias("k")).distinct().orderBy("k").limit(MOST_KEYS + 1).collect()]
            if len(names) > MOST_KEYS:
                raise ValueError(f"more than {MOST_KEYS} different keys in {path}: they can't be columns")
            return [x for n in names for x in leaves(f"{path}.{n}", column.getItem(n), kind.valueType)]
        return [(path, column)]

    return df.select(*[c.alias(n) for n, c in leaves("", F.lit(None), df.schema)])


def stats(df: DataFrame) -> DataFrame:
    """One row: records, the span of timestamps, keys seen and levels seen (sorted, comma-joined)."""
    level, ts = F.lower(first_of(LEVEL_KEYS, df.columns)), first_of(TIMESTAMP_KEYS, df.columns)
    seen = [F.when(F.count(F.col(f"`{c}`")) > 0, F.lit(c)) for c in df.columns]
    return df.agg(F.count(F.lit(1)).alias("records"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.array_join(F.array_sort(F.array_compact(F.array(*seen))), ",").alias("keys"), F.array_join(F.array_sort(F.collect_set(level)), ",").alias("levels"))


def lookup(df: DataFrame, table: dict[str, str], column: str, name: str, default: str | None = None) -> DataFrame:
    """df with the value that a constant table has for column."""
    entries = F.create_map(*[F.lit(x) for kv in table.items() for x in kv]) if table else F.create_map().cast("map<string,string>")
    found = F.try_element_at(entries, F.col(column).cast("string"))
    return df.withColumn(name, found if default is None else F.coalesce(found, F.lit(default)))


def summaries(body: DataFrame, begin: DataFrame | None = None, end: DataFrame | None = None, order: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Header rows, records, footer rows, with `part` 0, 1, 2 to sort by after by and before order."""
    parts = [x.withColumn("part", F.lit(i)) for i, x in enumerate((begin, body, end)) if x is not None]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out.orderBy(*(by or []), "part", order) if order else out
