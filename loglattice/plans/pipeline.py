"""Pipelines of record steps, in the order of the calls. Expressions are columns or Spark SQL text.

    Pipeline(spark.read.parquet(path), order="event_id").levels(include=["error"]).derive(k="get_json_object(props, '$.k')").keys(["event_id", "k"]).frame
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import evaluates, passes
from ..operators import chunking, folds, levels, ordering, records
from ..sources import readers, writers


def expression(e: Column | str) -> Column:
    return F.expr(e) if isinstance(e, str) else e


#: Header rows of each file, at most.
MOST_HEADER = 1000

#: Parts of expressions that never raise an error, by Spark's names, whatever they are given.
SAFE = {
    "Alias", "AttributeReference", "Literal", "And", "Or", "Not", "IsNull", "IsNotNull", "IsNaN", "EqualTo", "EqualNullSafe", "LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual", "In", "InSet", "Coalesce", "CaseWhen", "If", "Greatest", "Least",
    "Upper", "Lower", "Length", "OctetLength", "Contains", "StartsWith", "EndsWith", "StringTrim", "StringTrimLeft", "StringTrimRight", "Concat", "ConcatWs", "GetStructField", "GetJsonObject", "Substring", "StringReplace", "Size", "CreateNamedStruct", "CreateArray", "NullIf",
}
#: Arithmetic that can't fail on floating-point numbers, and casts to a type from any of those, which lose nothing.
ARITHMETIC = {"Add", "Subtract", "Multiply", "UnaryMinus", "Abs"}
WIDER = {"bigint": {"int", "smallint", "tinyint"}, "int": {"smallint", "tinyint"}, "double": {"bigint", "int", "smallint", "tinyint", "float"}, "timestamp": {"date"}}


def may_fail(df: DataFrame, e: Column) -> bool:
    """Whether e holds more than what is known never to raise an error."""

    def fails(node) -> bool:
        kind, children = node.nodeName(), node.children()
        below = [children.apply(i) for i in range(children.size())]
        name = node.getClass().getSimpleName()
        if name == "Cast":
            to, of = node.dataType().simpleString(), below[0].dataType().simpleString()
            ok = to in (of, "string") or of in WIDER.get(to, ())
        elif name in ARITHMETIC:
            ok = node.dataType().simpleString() in ("double", "float")
        else:
            ok = name in SAFE or kind in SAFE
        return not ok or any(map(fails, below))

    return fails(df.select(e.alias("e"))._jdf.queryExecution().analyzed().expressions().apply(0))


def counted(seen: Observation) -> dict[str, int]:
    """What an observation counted; nothing where the optimizer left its step out, as no record could reach the result."""
    try:
        return seen.get
    except Exception as error:  # noqa: BLE001  of the gateway
        if "AssertionError" not in f"{type(error).__name__} {error}":
            raise
        return {}


@dataclass(frozen=True)
class StepCount:
    """What a step did: records that came to it, that it dropped as its expression failed on them (wrong), and that left it."""

    step: str
    came: int
    wrong: int
    left: int

    @property
    def dropped(self) -> int:
        """Records that the step took out on purpose; below 0, as many as it added."""
        return self.came - self.wrong - self.left


@dataclass(frozen=True)
class Report:
    """A run by steps, and what its last records have: the columns that are not always null, and the families of their levels."""

    steps: tuple[StepCount, ...]
    keys: tuple[str, ...]
    levels: dict[str, int]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, s.step, s.came, s.dropped, s.wrong, s.left) for i, s in enumerate(self.steps, 1)]
        return spark.createDataFrame(rows, "place int, step string, came long, dropped long, wrong long, remained long")


def step(method: Callable) -> Callable:
    """A step of a pipeline that counts what it does, where a report is wanted."""

    @functools.wraps(method)
    def run(self, *args, **kwargs):
        made = method(self, *args, **kwargs)
        return made._observed(method.__name__, self) if self.counts else made

    return run


@dataclass(frozen=True)
class Pipeline:
    """frame: the records so far. order: the column that orders them; by: columns within which order holds, a file's name by default.

    errors: records for which a step's expression raises an error are dropped (`skip`), or end the run (`fail`). What
    can't raise one is left to Spark as it is, so that filters reach the files. Aggregates and windows aren't guarded.
    """

    frame: DataFrame
    order: str | None = None
    by: tuple[str, ...] = ()
    header: DataFrame | None = None
    footer: DataFrame | None = None
    errors: str = "skip"
    seen: tuple[Observation, ...] = ()
    common_only: bool = False
    #: name of each step, where its records are counted, and where those that are wrong are; None: no report.
    counts: tuple[tuple[str, Observation, tuple[Observation, ...]], ...] | None = None

    @classmethod
    def read(cls, spark: SparkSession, paths: str | list[str], fmt: str | None = None, errors: str = "skip", **options) -> Pipeline:
        """errors: as for readers.read and for steps; with `keep`, rejected lines stay and steps drop what fails.

        Records are numbered, which costs an exchange; numbered=False reads CSV and JSON Lines without.
        """
        seen = Observation()
        df = readers.read(spark, paths, fmt, seen=seen, errors=errors, **{"numbered": True, **options})
        numbered, counted = "LINENUM" in df.columns, readers.format_of([paths] if isinstance(paths, str) else paths, fmt) not in ("parquet", "orc")
        return cls(df, "LINENUM" if numbered else None, ("FILENAME",) if numbered else (), errors="fail" if errors == "fail" else "skip", seen=(seen,) if counted else ())

    def _without_failures(self, e: Column) -> Pipeline:
        """The pipeline less the records for which e raises an error. What is counted on the way keeps Spark from
        evaluating e before those are gone."""
        if self.errors == "fail" or not may_fail(self.frame, e):
            return self
        failed = Observation()
        hashable = not re.search("map<|variant", self.frame.select(e.alias("e")).dtypes[0][1])
        frame = self.frame.withColumn("__ok", evaluates(e, hashable)).observe(failed, F.count_if(~F.col("__ok")).alias("errors"))
        return replace(self, frame=frame.where("__ok").drop("__ok"), seen=(*self.seen, failed))

    def reported(self) -> Pipeline:
        """From here on each step counts its records, for write's report. What counts keeps filters from passing it."""
        return replace(self, counts=())._observed("input", self)

    def _observed(self, name: str, before: Pipeline) -> Pipeline:
        left = Observation()
        return replace(self, frame=self.frame.observe(left, F.count(F.lit(1)).alias("left")), counts=(*(self.counts or ()), (name, left, self.seen[len(before.seen):])))

    def _report(self, last: Observation) -> Report:
        steps, came = [], None
        for name, left, wrong in self.counts:
            n, bad = counted(left).get("left", 0), sum(counted(x).get("errors", 0) for x in wrong)
            steps.append(StepCount(name, n if came is None else came, bad, n))
            came = n
        found = counted(last)
        return Report(tuple(steps), tuple(k[4:] for k, n in found.items() if k.startswith("key_") and n), {k[6:]: n for k, n in found.items() if k.startswith("level_") and n})

    def _with(self, frame: DataFrame) -> Pipeline:
        return replace(self, frame=frame)

    def _ordered(self) -> str:
        if not self.order:
            raise ValueError("this step needs an order: Pipeline(frame, order=...)")
        return self.order

    @step
    def filter(self, condition: Column | str) -> Pipeline:
        """Rows whose value passes as true; null doesn't."""
        kind = self.frame.select(expression(condition).alias("c")).dtypes[0][1]
        value = expression(condition)
        p = self._without_failures(value)
        return p._with(p.frame.where(passes(value, kind)))

    @step
    def eval(self, value: Column | str) -> Pipeline:
        """The value becomes the record's line; rows where it is null go."""
        keep = [c for c in (self.order, *self.by) if c and c != "line"]
        line = expression(value).cast("string")
        p = self._without_failures(line)
        made = p.frame.withColumn("__line", line)
        return p._with(made.where("__line is not null").select(*keep, F.col("__line").alias("line")))

    @step
    def derive(self, *scratch: str, **columns: Column | str | None) -> Pipeline:
        """New or changed columns, one after another; None deletes one; names that start with _ are not kept."""
        p = self
        for name, value in columns.items():
            if value is None:
                p = p._with(p.frame.drop(name))
            else:
                p = p._without_failures(expression(value))
                p = p._with(p.frame.withColumn(name, expression(value)))
        return p._with(p.frame.drop(*[c for c in columns if c.startswith("_")], *scratch))

    @step
    def select(self, **columns: Column | str) -> Pipeline:
        """Records of new columns, from lines or other columns."""
        keep, p = [c for c in (self.order, *self.by) if c and c not in columns], self
        for value in columns.values():
            p = p._without_failures(expression(value))
        return p._with(p.frame.select(*keep, *[expression(v).alias(k) for k, v in columns.items()]))

    @step
    def extract_vars(self, template: str, line: str = "line") -> Pipeline:
        return self._with(records.extract_vars(self.frame, template, line))

    @step
    def levels(self, include: list[str] | None = None, exclude: list[str] | None = None, level: str | None = None, text: str | None = None) -> Pipeline:
        text = text or ("line" if level is None and "line" in self.frame.columns and not any(k in self.frame.columns for k in levels.LEVEL_KEYS) else None)
        return self._with(levels.filter_levels(self.frame, include, exclude, level, text))

    def level_map(self, width: int = 80, **options) -> DataFrame:
        if self.frame.columns == ["line"]:
            raise ValueError("a level map needs records with a level")
        return levels.level_map(self.frame, self._ordered(), width, **options)

    @step
    def chunk(self, lines: int | None = None, start: str | None = None, delimiter: str | None = None) -> Pipeline:
        if "line" not in self.frame.columns:
            raise ValueError("only lines can be chunked")
        made = chunking.chunked(self.frame, lines, start, delimiter, order=self._ordered(), by=list(self.by))
        return replace(self, frame=made.withColumnRenamed("text", "line"), order="start_line") if made is not self.frame else self

    @step
    def window(self, n: int, **columns) -> Pipeline:
        """Columns over the last n records that reach this step: functions from a window, see operators.ordering.

        What they take isn't guarded, as they see many records: derive before what may raise an error.
        """
        return self._with(ordering.trailing(self.frame, n, self._ordered(), columns, list(self.by)))

    @step
    def inc(self, name: str, by: list[str] | None = None, amount: Column | str | None = None, when: Column | str | None = None) -> Pipeline:
        """A running count or sum, within by."""
        value = F.lit(1).cast("long") if amount is None else expression(amount)
        if when is not None:
            value = F.when(expression(when), value).otherwise(0)
        p = self._without_failures(value)
        return p._with(ordering.running_total(p.frame, value, name, self._ordered(), by if by is not None else list(self.by)))

    @step
    def emit(self, emissions: Column | str, primary: bool = True) -> Pipeline:
        p = self._without_failures(expression(emissions))
        return p._with(records.emit(p.frame, expression(emissions), primary=primary))

    @step
    def skip(self, condition: Column | str) -> Pipeline:
        value = expression(condition)
        p = self._without_failures(value)
        return p._with(p.frame.where(~F.coalesce(value, F.lit(False))))

    @step
    def exit(self, condition: Column | str, message: Column | str | None = None) -> Pipeline:
        """Nothing after the first record where condition holds, within each file."""
        p = self._without_failures(expression(condition))
        if message is not None:
            p = p._without_failures(F.when(expression(condition), expression(message)))
        return p._with(ordering.until_exit(p.frame, expression(condition), self._ordered(), list(self.by), None if message is None else expression(message)))

    def begin(self, frame: DataFrame, each: bool = False) -> Pipeline:
        """Header rows; each: before the records of each of by, that is of each file, which may have MOST_HEADER of them."""
        if not (each and self.by):
            return replace(self, header=frame)
        rows = frame.limit(MOST_HEADER + 1).collect()
        if len(rows) > MOST_HEADER:
            raise ValueError(f"a header of each file has {MOST_HEADER} rows at most")
        header = F.explode(F.array(*[F.struct(*[F.lit(v).cast(t).alias(c) for v, (c, t) in zip(r, frame.dtypes, strict=True)]) for r in rows]))
        return replace(self, header=self.frame.select(*self.by).distinct().withColumn("__head", header).select(*self.by, "__head.*"))

    def end(self, **aggregates: Column | str) -> Pipeline:
        """A footer of aggregates over the records that reach this step; one for each of by, that is each file.

        What aggregates take isn't guarded, as they see many records: derive before what may raise an error.
        """
        found = self.frame.groupBy(*self.by).agg(*[expression(v).alias(k) for k, v in aggregates.items()])
        return replace(self, footer=found)

    def fold(self, fold: folds.Fold, schema: str, columns: list[str] | None = None, name: str = "state") -> Pipeline:
        """A footer of what a fold makes of the records that reach this step; one for each of by, that is each file."""
        return replace(self, footer=folds.folded(self.frame, fold, schema, list(self.by), columns, name))

    @step
    def keys(self, names: list[str]) -> Pipeline:
        return self._with(records.keys(self.frame, names))

    @step
    def remove_keys(self, names: list[str]) -> Pipeline:
        return self._with(records.remove_keys(self.frame, names))

    def common(self, more: list[str] | None = None) -> Pipeline:
        return replace(self, frame=records.common_keys(self.frame, more), common_only=True)

    def stats(self) -> DataFrame:
        return records.stats(self.frame)

    def result(self) -> DataFrame:
        """Header, records and footer in one frame; without header and footer, the records."""
        if self.header is None and self.footer is None:
            return self.frame
        order = self.order if self.order in self.frame.columns else None
        return records.summaries(self.frame, self.header, self.footer, order, [c for c in self.by if c in self.frame.columns and all(c in x.columns for x in (self.header, self.footer) if x is not None)])

    def write(self, path: str, fmt: str | None = None, mode: str = "error", colours: bool = False, code: int | None = None, ordered: bool = False) -> writers.RunResult:
        """Writes the result and tells how many records were read, wrong and written. code: an exit code of one's own.

        ordered: in the records' order over all files by name, header and footer in their places; csv and tsv with one header.
        """
        frame, order, drop = self.result(), None, []
        text = frame.columns == ["line"]
        if ordered:
            shared = [c for c in self.by if all(c in x.columns for x in (frame, self.header, self.footer) if x is not None)]
            order = [c for c in (*shared, "part", *[c for c in self.by if c not in shared], self._ordered()) if c in frame.columns]
            text = "line" in frame.columns and set(frame.columns) <= {"line", *order}
            drop = [c for c in frame.columns if c != "line"] if text and fmt in (None, "line") else ["part"]
        fmt = fmt or ("line" if text else "logfmt")
        if self.common_only and fmt in ("csv", "tsv"):
            raise ValueError("common keys have no fixed columns, as csv and tsv need: name them by keys()")
        last = Observation()
        if self.counts is not None:
            level = writers.family_of(levels.level_of(self.frame, text="line" if "line" in self.frame.columns else None))
            seen = [F.count(F.col(f"`{c}`")).alias(f"key_{c}") for c in frame.columns] + [F.count_if(level == f).alias(f"level_{f}") for f in levels.FAMILIES]
            frame = frame.observe(last, *seen)
        done = writers.write(frame, path, fmt, mode, colours=colours, order=order, drop=drop)
        counts = [counted(x) for x in self.seen]
        read = next((c["read"] for c in counts if "read" in c), None)
        return replace(done, errors=sum(c.get("errors", 0) for c in counts), code=code, read=read, report=None if self.counts is None else self._report(last))
