"""Structured Streaming variants. Stateless steps run on streams as they are; these need state or event time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def follow_lines(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Lines of files as they come into a folder, with FILENAME; blank ones left out."""
    text = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder)
    return text.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("FILENAME")).where(F.trim("line") != "")


def follow_table(spark: SparkSession, folder: str, schema: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def windowed_counts(events: DataFrame, time: str, length: str, by: list[str], late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts of event-time windows, tumbling or sliding; rows later than `late` are left out."""
    span = F.window(time, length, slide) if slide else F.window(time, length)
    return events.withWatermark(time, late).groupBy(span.alias("window"), *by).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, time: str, gap: str, by: list[str], late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), *by).agg(F.count(F.lit(1)).alias("n"))


def counters(events: DataFrame, key: str, amount: Column | None = None) -> DataFrame:
    """Running totals by key, as an update-mode aggregate: the streaming form of a counter and of an end summary."""
    value = F.lit(1).cast("long") if amount is None else amount
    return events.groupBy(key).agg(F.sum(value).alias("total"))


def last_records(events: DataFrame, key: str, order: str, value: str, n: int) -> DataFrame:
    """For each record the sum, number and texts of the last n values within key, the current one included; state holds n values."""

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(order, ignore_index=True)
        sums, sizes = [], []
        for x in rows[value].astype(float):
            kept = [*kept, float(x)][-n:]
            sums.append(sum(kept))
            sizes.append(len(kept))
        state.update((kept,))
        yield pd.DataFrame({key: [group[0]] * len(rows), order: rows[order], "window_sum": sums, "window_size": sizes})

    kinds = dict(events.dtypes)
    out = f"{key} {kinds[key]}, {order} {kinds[order]}, window_sum double, window_size long"
    return events.select(key, order, value).groupBy(key).applyInPandasWithState(step, out, "kept array<double>", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """All that a stream has now, as a table in memory: for tests and small results."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


CHUNKS = "start_line long, n_lines long, text string, whole boolean"


def chunks(lines: DataFrame, key: str, order: str, line: str = "line", start: str | None = None, delimiter: str | None = None, end: str | None = None, timeout: str | None = "1 minute", most_lines: int = 100_000) -> DataFrame:
    """Multi-line records of a stream of numbered lines, within key, as operators.chunking has them of stored ones.

    A chunk starts at each line that the regular expression `start` finds, or lies between lines equal to `delimiter` but for
    white space around. It goes out once the next one begins; the last one of a key after `timeout` without lines, or
    with the line where the boolean column `end` is true. State holds the unfinished chunk's lines, one record each,
    most_lines at most: of a longer one, parts go out, of which only the last may be `whole`. Lines of a key must come in
    order over batches; within a batch they are sorted. With a timeout Spark runs batches until the stream is stopped, so
    one that ends with what is available now has none (timeout=None). Lines that come again, with numbers already seen, are left out.
    """
    if (start is None) == (delimiter is None):
        raise ValueError("either start or delimiter says where chunks begin")
    begins = re.compile(start) if start is not None else None
    between = delimiter.strip() if delimiter is not None else None
    kind = dict(lines.dtypes)[key]

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, held, last = state.get if state.exists else (-1, [], -1)
        held, out = list(held), []

        def flush(whole: bool = True) -> None:
            nonlocal held
            if held:
                out.append((group[0], first, len(held), "\n".join(held), whole))
            held = []

        if state.hasTimedOut:
            flush()
        else:
            rows = pd.concat(list(frames)).sort_values(order, kind="stable", ignore_index=True)
            for at, text, ends in zip(rows[order].tolist(), rows[line].tolist(), rows["__end"].tolist(), strict=True):
                if at <= last:
                    continue
                last, text = at, text or ""
                if between is not None and text.strip() == between:
                    flush()
                else:
                    if begins is not None and begins.search(text):
                        flush()
                    elif len(held) >= most_lines:
                        flush(whole=False)
                    first = first if held else at
                    held.append(text)
                if ends:
                    flush()
        state.update((first, held, last))
        if held and timeout is not None:
            state.setTimeoutDuration(timeout_ms)
        if out:
            yield pd.DataFrame(out, columns=[key, "start_line", "n_lines", "text", "whole"])

    number, unit = (timeout or "0 seconds").split()
    timeout_ms = int(float(number) * {"second": 1000, "minute": 60_000, "hour": 3_600_000}[unit.rstrip("s")])
    numbered = lines.select(key, F.col(order).cast("long").alias(order), line, (F.coalesce(F.col(end), F.lit(False)) if end else F.lit(False)).alias("__end"))
    return numbered.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {CHUNKS}", "first long, held array<string>, last long", "append", GroupStateTimeout.NoTimeout if timeout is None else GroupStateTimeout.ProcessingTimeTimeout)
