"""Functions from columns to columns. All of them stay in the JVM; a value that a function can't take gives null."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

C = Column | str


#: White space by Unicode.
SPACE = r"[\s\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is evaluated once, however often then uses it."""
    return F.transform(F.array(value), then)[0]


def stripped(text: C) -> Column:
    """text without white space at its ends."""
    return F.regexp_replace(col(text), rf"\A{SPACE}+|{SPACE}+\z", "")


def evaluates(value: Column, hashable: bool = True) -> Column:
    """Whether value can be evaluated, be it to null, without an error. Values with maps in them are not hashable.

    Of a date and days, try_add gives null for whatever error comes up. Days are 0, but take the value to tell.
    """
    return F.try_add(F.lit(datetime.date(2000, 1, 1)), F.pmod(F.hash(value if hashable else F.to_json(F.struct(value.alias("v")))), F.lit(1))).isNotNull()


# -- regular expressions ------------------------------------------------------------------------------------------


def valid_regex(pattern: str) -> bool:
    """Whether Java takes the pattern."""
    jvm = SparkSession.getActiveSession().sparkContext._jvm
    try:
        jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # noqa: BLE001  whatever the gateway raises for a PatternSyntaxException
        return False
    return True


def regex_match(pattern: str, text: C) -> Column:
    """Whether the pattern occurs in text; False for a pattern that is no valid expression."""
    return col(text).rlike(pattern) if valid_regex(pattern) else F.lit(False)


def regex_replace(pattern: str, replacement: str, text: C) -> Column:
    """All occurrences replaced; $1 and ${name} stand for groups, a backslash for itself."""
    return F.regexp_replace(col(text), pattern, replacement.replace("\\", "\\\\"))


def regex_find_all(pattern: str, text: C) -> Column:
    return F.regexp_extract_all(col(text), F.lit(pattern), F.lit(0))


# -- JSON, CSV, key-value -----------------------------------------------------------------------------------------


def parse_json(text: C, schema: str | None = None) -> Column:
    """A variant, or a value of the given schema; null for bad JSON."""
    return F.try_parse_json(col(text)) if schema is None else F.from_json(col(text), schema, {"mode": "PERMISSIVE"})


def dump_json(value: C) -> Column:
    return F.to_json(col(value))


def csv_fields(line: C, sep: str = ",") -> Column:
    """The fields of a line, quotes taken off; an empty line has none. A quote that isn't closed holds up to the end."""
    s = re.escape(sep)
    raw = F.regexp_extract_all(F.concat(F.lit(sep), col(line)), F.lit(rf'{s}("(?:[^"]|"")*+(?:"[^{s}]*|\z)|[^{s}]*)'), F.lit(1))
    inner = lambda x: F.regexp_extract(x, r'(?s)\A"((?:[^"]|"")*+)"?(.*)\z', 1)
    after = lambda x: F.regexp_extract(x, r'(?s)\A"((?:[^"]|"")*+)"?(.*)\z', 2)
    fields = F.transform(raw, lambda x: F.when(x.startswith('"'), F.concat(F.replace(inner(x), F.lit('""'), F.lit('"')), after(x))).otherwise(x))
    return F.when(col(line) == "", F.array().cast("array<string>")).otherwise(fields)


def parse_csv(line: C, headers: list[str] | None = None, sep: str = ",") -> Column:
    """A map from header to field; without headers col1, col2, ...; missing fields are empty, further ones left out."""
    fields = csv_fields(line, sep)
    if headers is None:
        return F.map_from_entries(F.transform(fields, lambda x, i: F.struct(F.concat(F.lit("col"), (i + 1).cast("string")), x)))
    pairs = [F.struct(F.lit(h), F.coalesce(F.get(fields, F.lit(i)), F.lit(""))) for i, h in enumerate(headers)]
    return F.when(col(line) == "", F.create_map().cast("map<string,string>")).otherwise(F.map_from_entries(F.array(*pairs)))


def dump_csv(values: C, delimiter: str = ",") -> Column:
    return F.array_join(F.transform(col(values), lambda x: x.cast("string")), delimiter)


def parse_kv(line: C, sep: str = "=", delim: str = " ") -> Column:
    """A map of the pairs in line; words without sep are left out; the last of equal keys counts."""
    pairs = F.filter(F.split(col(line), re.escape(delim)), lambda x: F.contains(x, F.lit(sep)))
    split = F.transform(pairs, lambda x: F.struct(F.substring_index(x, sep, 1).alias("k"), x.substr(F.length(F.substring_index(x, sep, 1)) + len(sep) + 1, F.length(x)).alias("v")))
    last = F.filter(split, lambda x, i: ~F.exists(F.slice(split, i + 2, F.size(split) + 1), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


# -- text ---------------------------------------------------------------------------------------------------------


def byte_length(text: C) -> Column:
    return F.octet_length(col(text))


def words(text: C, sep: str = "") -> Column:
    """Fields between sep, a literal; between runs of white space where sep is empty."""
    if sep:
        return F.split(col(text), re.escape(sep))
    return F.filter(F.split(col(text), rf"{SPACE}+"), lambda x: x != "")


def cols(text: C, *specs: int | str, sep: str = "", outsep: str = " ") -> Column:
    """Fields of text. A spec is a place, several (`0,2`) or a slice (`1:3`); negative places count from the end.

    A place outside gives an empty text, one among several nothing. One spec gives a text, several an array.
    """
    fields = words(text, sep)
    n = F.size(fields)

    def place(i: int) -> Column:
        return F.get(fields, F.lit(i) if i >= 0 else n + i)

    def one(spec: int | str) -> Column:
        if isinstance(spec, int):
            return F.coalesce(place(spec), F.lit(""))
        if ":" in spec:
            a, b = (int(x) if x.strip() else None for x in spec.split(":"))
            bound = lambda x, default: default if x is None else F.least(n, F.lit(x)) if x >= 0 else F.greatest(F.lit(0), n + x)
            low, high = bound(a, F.lit(0)), bound(b, n)
            return F.array_join(F.slice(fields, low + 1, F.greatest(F.lit(0), high - low)), outsep)
        places = [int(x) for x in spec.split(",")]
        if len(places) == 1:
            return F.coalesce(place(places[0]), F.lit(""))
        return F.array_join(F.array(*[place(i) for i in places]), outsep)

    found = [one(s) for s in specs]
    return found[0] if len(found) == 1 else F.array(*found)


def capitalize(text: C) -> Column:
    return F.concat(F.upper(col(text).substr(1, 1)), F.lower(col(text).substr(F.lit(2), F.length(col(text)))))


def removeprefix(text: C, prefix: str) -> Column:
    return F.when(col(text).startswith(prefix), col(text).substr(F.lit(len(prefix) + 1), F.length(col(text)))).otherwise(col(text))


def removesuffix(text: C, suffix: str) -> Column:
    return F.when(col(text).endswith(suffix), col(text).substr(F.lit(1), F.length(col(text)) - len(suffix))).otherwise(col(text))


def partition(text: C, sep: str) -> Column:
    """What stands before sep, sep, and what follows; the whole and two empty texts without it."""
    t, at = col(text), F.instr(col(text), sep)
    return F.when(at > 0, F.array(t.substr(F.lit(1), at - 1), F.lit(sep), t.substr(at + len(sep), F.length(t)))).otherwise(F.array(t, F.lit(""), F.lit("")))


def count_of(text: C, part: str) -> Column:
    return F.regexp_count(col(text), F.lit(re.escape(part)))


def truthy(value: C, kind: str) -> Column:
    """A filter's view of a value of the given Spark type: null, False, an empty text and integer 0 don't pass."""
    return F.coalesce(passes(value, kind), F.lit(False))


def passes(value: C, kind: str) -> Column:
    """truthy(), but null for null: the same in where(), and Spark can hand it on to the files."""
    v = col(value)
    if kind == "boolean":
        return v
    if kind == "string":
        return v != ""
    return v != 0 if kind in ("tinyint", "smallint", "int", "bigint") else v.isNotNull()


# -- time ---------------------------------------------------------------------------------------------------------

# strftime's directives and Java's pattern letters.
STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%b": "MMM", "%B": "MMMM", "%y": "yy", "%z": "xx", "%j": "DDD", "%I": "hh", "%p": "a", "%a": "E", "%A": "EEEE", "%%": "%", "%T": "HH:mm:ss", "%F": "yyyy-MM-dd", "%e": "d"}


def java_pattern(fmt: str) -> str:
    """A strftime format as a Java date pattern."""
    out = []
    for m in re.finditer(r"%.|[A-Za-z]+|'|[^%A-Za-z']+", fmt):
        part = m[0]
        if part[0] == "%":
            if part not in STRFTIME:
                raise ValueError(f"{part} in {fmt!r} is not supported")
            out.append(STRFTIME[part])
        else:
            out.append("''" if part == "'" else f"'{part}'" if part[0].isalpha() else part)
    return "".join(out)


def _epoch(text: Column, pattern: str) -> Column:
    """Seconds since 1970 in UTC; patterns without a zone are in UTC."""
    return F.unix_seconds(F.try_to_timestamp(text, F.lit(pattern)))


def parse_ts(text: C, fmt: str | None = None) -> Column:
    """Epoch seconds: of RFC 3339, date and time with T or space, or a date; or by a strftime format. The session is in UTC."""
    t = col(text)
    if fmt:
        return _epoch(t, java_pattern(fmt))
    return F.coalesce(*[_epoch(t, p) for p in ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")])


def format_ts(epoch: C, fmt: str | None = None) -> Column:
    pattern = java_pattern(fmt) if fmt else "yyyy-MM-dd'T'HH:mm:ssxxx"
    return F.date_format(F.timestamp_seconds(col(epoch)), pattern)


def now() -> Column:
    """Seconds since 1970, the same for all rows of a query."""
    return F.unix_timestamp()


def ts_diff(a: C, b: C) -> Column:
    return col(a) - col(b)


def ts_add(ts: C, seconds: C) -> Column:
    return col(ts) + col(seconds)


# Date formats that are tried in order, after weekdays, brackets, commas and long fractions are dealt with.
GUESSES = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd HH:mm", "yyyy-MM-dd",
    "dd/MMM/yyyy:HH:mm:ss xx", "yyyyMMdd'T'HHmmss", "yyyyMMddHHmm", "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy", "yyyy-MM-dd-HH.mm.ss[.SSSSSS]",
    "dd-MM-yyyy HH:mm:ss", "dd-MM-yyyy", "yy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy", "MMM d HH:mm:ss yyyy",
    "d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm:ss", "d MMM yyyy", "MMM d, yyyy HH:mm:ss", "MMM d, yyyy", "yyyy MMM d HH:mm:ss",
)


# What Java's pattern letters match.
SHAPES = {"yyyy": r"\d{4}", "yy": r"\d{2}", "MMM": "[A-Za-z]{3}", "MM": r"\d{2}", "dd": r"\d{2}", "d": r"\d{1,2}", "HH": r"\d{2}", "mm": r"\d{2}", "ss": r"\d{2}", "SSSSSS": r"\d{6}", "XXX": r"(?:Z|[+-]\d{2}:\d{2})", "xx": r"[+-]\d{4}"}


def shape_of(pattern: str) -> str:
    """An expression for the texts that a Java date pattern may fit: a format is tried only on these."""
    out = []
    for m in re.finditer(r"'([^']*)'|([A-Za-z])\2*|\[|\]|.", pattern):
        part = m[0]
        out.append(re.escape(m[1]) if m[1] is not None else "(?:" if part == "[" else ")?" if part == "]" else SHAPES[part] if part in SHAPES else re.escape(part))
    return rf"\A{''.join(out)}\z"


def guess_ts(text: C) -> Column:
    """Epoch seconds of a text in one of many formats, in UTC where it names no zone; the current year where it names none."""
    return bound(_cleaned(stripped(text)), lambda t: bound(_dated(t), lambda dated: _guessed(t, dated)))


def _cleaned(t: Column) -> Column:
    t = F.regexp_replace(t, r"^\[(.*)\]$", "$1")
    t = F.regexp_replace(t, r"^(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", "")
    t = F.regexp_replace(t, r"(\d:\d\d:\d\d),(\d)", "$1.$2")
    t = F.regexp_replace(t, r"(\.\d{6})\d+", "$1")
    t = F.regexp_replace(t, r"(:\d\d\.\d+)", "$1000000")
    t = F.regexp_replace(t, r"(\d\d[:.]\d\d[:.]\d\d\.\d{6})\d*", "$1")
    return F.regexp_replace(t, r"\s+", " ")


def _dated(t: Column) -> Column:
    return F.when(t.rlike(r"^[A-Za-z]{3} \d{1,2} \d\d:\d\d:\d\d$"), F.concat(F.year(F.current_date()).cast("string"), F.lit(" "), t)).otherwise(t)


def _guessed(t: Column, dated: Column) -> Column:
    seconds = F.when(t.rlike(r"^\d{9,10}$"), t.try_cast("bigint")).when(t.rlike(r"^\d{13}$"), F.floor(t.try_cast("bigint") / 1000)).when(t.rlike(r"^\d{10}\.\d+$"), F.floor(t.try_cast("double")))
    return F.coalesce(seconds, *[F.when(dated.rlike(shape_of(p)), _epoch(dated, p)) for p in GUESSES])


# Seconds of the units of compact durations, and of durations in words.
COMPACT = {"us": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0, "w": 604800.0}
IN_WORDS = {
    "nsec ns nanos": 1e-9, "usec us": 1e-6, "msec ms millis": 1e-3, "seconds second secs sec s": 1.0, "minutes minute mins min m": 60.0, "hours hour hrs hr h": 3600.0,
    "days day d": 86400.0, "weeks week wks wk w": 604800.0, "months month M": 2630016.0, "years year yrs yr y": 31557600.0,
}


def _lookup(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def parse_duration(text: C) -> Column:
    """Seconds of a compact duration (`3h30m`, `1.5h`), or of one in words (`1 hour 30 minutes`); null for others, negative ones too."""
    t = col(text)

    def total(pairs: Column, number: str, units: Column) -> Column:
        return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + F.regexp_extract(x, number, 0).try_cast("double") * F.try_element_at(units, F.regexp_extract(x, "[A-Za-z]+$", 0)))

    compact = F.regexp_extract_all(t, F.lit("[-0-9.]+[a-z]+"), F.lit(0))
    negative = F.exists(compact, lambda x: x.startswith("-"))
    spelled = {u: s for us, s in IN_WORDS.items() for u in us.split()}
    long = F.when(t.rlike(r"^\s*(?:\d+\s*[A-Za-z]+\s*)+$"), total(F.regexp_extract_all(t, F.lit(r"\d+\s*[A-Za-z]+"), F.lit(0)), r"^\d+", _lookup(spelled)))
    return F.when(~negative, F.coalesce(F.when(F.size(compact) > 0, total(compact, "^[-0-9.]+", _lookup(COMPACT))), long))


# -- nested values and lists --------------------------------------------------------------------------------------


def get_path(path: str, data: C, default: str | None = None) -> Column:
    """The text at a dotted path of a JSON text, with list places as numbers; default where there is none."""
    if not path:
        return col(data)
    steps = "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split("."))
    if any(re.fullmatch(r"-\d+", p) for p in path.split(".")):
        return F.lit(default).cast("string")
    found = F.get_json_object(col(data), f"${steps}")
    return found if default is None else F.coalesce(found, F.lit(default))


def _doubles(values: C) -> Column:
    return F.transform(col(values), lambda x: x.try_cast("double"))


def list_sum(values: C) -> Column:
    """The sum as a double; 0 for an empty list, null where an item is no number."""
    return F.aggregate(_doubles(values), F.lit(0.0), lambda s, x: s + x)


def list_avg(values: C) -> Column:
    """The mean; null for an empty list."""
    return F.when(F.size(col(values)) > 0, list_sum(values) / F.size(col(values)))


def list_percentile(values: C, p: float) -> Column:
    """The p-th percentile, p from 0 to 100, by linear interpolation; null for an empty list, another p, or an item that is no number."""
    if not 0 <= p <= 100:
        return F.lit(None).cast("double")

    def of(ordered: Column) -> Column:
        at = (F.size(ordered) - 1) * (p / 100.0)
        low = F.floor(at).cast("int")
        a, b = F.get(ordered, low), F.get(ordered, F.ceil(at).cast("int"))
        return F.when((F.size(ordered) > 0) & ~F.exists(ordered, lambda x: x.isNull()), a + (b - a) * (at - low))

    return bound(F.array_sort(_doubles(values)), of)


def round_half_up(x: C, digits: int = 0) -> Column:
    """Rounds the binary value, half away from zero; what has no fraction at that digit is left as it is."""
    value = col(x).cast("double")
    scaled = value * float(10**digits)
    return F.when(F.abs(scaled) >= float(1 << 52), value).otherwise(F.signum(scaled) * F.floor(F.abs(scaled) + 0.5) / float(10**digits))


def power(base: C, exponent: C | float) -> Column:
    return F.pow(col(base).cast("double"), exponent if isinstance(exponent, int | float) else col(exponent).cast("double"))


def absolute(x: C) -> Column:
    return F.abs(col(x).cast("double"))


def first_of(names: list[str], columns: list[str]) -> Column:
    """The first of names that is among columns and not null, as text."""
    found = [F.col(f"`{n}`").cast("string") for n in names if n in columns]
    return reduce(lambda a, b: F.coalesce(a, b), found) if found else F.lit(None).cast("string")
