"""Folds of one's own: state over many records, beyond counters, that is put together from parts.

Each task folds its records into a state for each group, a few groups at a time in memory, before anything is exchanged.
States of a group then merge in two rounds, first within parts of it, so that a group with records in every task is not
one task's work. What a fold does must not depend on how records are dealt out: merge is associative and commutative,
and a new state changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: States that a task holds at a time; parts of a group in the first round of merging.
MOST_STATES, PARTS = 10_000, 32


@dataclass(frozen=True)
class Fold:
    """init() makes a state, anything that JSON can hold; step(state, record) and merge(state, other) return the state that
    follows, and may change the first one; finish(state) makes the result of it. A record is a dict."""

    init: Callable[[], Any]
    step: Callable[[Any, dict], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], Any] = lambda state: state


def folded(df: DataFrame, fold: Fold, schema: str, by: Sequence[str] = (), columns: Sequence[str] | None = None, name: str = "state") -> DataFrame:
    """A row for each of by with the fold's result over its records, of the type that schema names, in column `name`.

    columns: what records hold, all but by unless given. A record for which step raises an error ends the run: filter before.
    Nulls in by are a group of their own. An empty table gives no groups.
    """
    by = list(by)
    columns = [c for c in df.columns if c not in by] if columns is None else list(columns)
    kinds = [StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(by)]
    keys = [f.name for f in kinds]
    states = StructType([*kinds]).add("state", "string").add("part", "integer")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, Any] = {}
        n = TaskContext.get().partitionId()

        def out() -> pa.RecordBatch:
            nonlocal n
            cols = list(zip(*[(*key, json.dumps(state), (n := n + 1) % PARTS) for key, state in found.items()], strict=True))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [*key_types, pa.string(), pa.int32()], strict=True)], names=[*keys, "state", "part"])

        key_types: list[pa.DataType] = []
        for batch in batches:
            key_types = [batch.schema.field(k).type for k in keys]
            of = list(zip(*(batch[k].to_pylist() for k in keys), strict=True)) if keys else [()] * batch.num_rows
            for key, record in zip(of, batch.select(columns).to_pylist(), strict=True):
                found[key] = fold.step(found[key] if key in found else fold.init(), record)
                if len(found) > MOST_STATES:
                    yield out()
        if found:
            yield out()

    def merging(last: bool):
        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come sorted by key, so that one state is held at a time."""
            now, state, rows, schema = None, None, [], None

            def out() -> pa.RecordBatch:
                made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows.clear()
                return made

            for batch in batches:
                schema = batch.schema
                for *key, text, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    at = (tuple(key), part if not last else 0)
                    if at != now:
                        if now:
                            rows.append((*now[0], json.dumps(fold.finish(state) if last else state), now[1]))
                        now, state = at, fold.init()
                    state = fold.merge(state, json.loads(text))
                    if len(rows) > 1000:
                        yield out()
            if now:
                rows.append((*now[0], json.dumps(fold.finish(state) if last else state), now[1]))
                yield out()

        return merge

    rows = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)], *[F.col(f"`{c}`") for c in columns])
    parts = rows.mapInArrow(step, states)
    some = parts.repartition(*keys, "part").sortWithinPartitions(*keys, "part").mapInArrow(merging(False), states)
    whole = (some.repartition(*keys) if keys else some.coalesce(1)).sortWithinPartitions(*keys, "part").mapInArrow(merging(True), states)
    return whole.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], F.from_json("state", schema).alias(name))


def counters(*path: str) -> Fold:
    """Nested counters: a count for each combination of the columns in path, as maps in maps of their values as text."""

    def step(state: dict, record: dict) -> dict:
        at = state
        for c in path[:-1]:
            at = at.setdefault(str(record[c]), {})
        last = str(record[path[-1]])
        at[last] = at.get(last, 0) + 1
        return state

    def merge(state: dict, other: dict) -> dict:
        for k, v in other.items():
            state[k] = merge(state.get(k, {}), v) if isinstance(v, dict) else state.get(k, 0) + v
        return state

    return Fold(dict, step, merge)
