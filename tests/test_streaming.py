"""Streams give what batches give."""

import random
import time

import pytest
from pyspark.sql import functions as F

from loglattice.operators import chunking, levels
from loglattice.streaming import streams

EVENTS = "/root/testdata/sf0.001/events.parquet"


def folder(spark, tmp_path, parts=3):
    df = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(parts):
        df.where(F.col("event_id") % parts == i).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    return df, str(tmp_path / "in" / "*")


def test_stateless_steps(spark, tmp_path):
    df, path = folder(spark, tmp_path)
    stream = streams.follow_table(spark, path, df.schema.simpleString()[7:-1].replace(":", " "))
    got = streams.run_once(levels.filter_levels(stream, include=["error"], level="event_type").select("event_id"), "errors")
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in df.where("event_type = 'error'").select("event_id").collect())


def test_counters_and_windows(spark, tmp_path):
    df, path = folder(spark, tmp_path)
    schema = df.schema.simpleString()[7:-1].replace(":", " ")
    got = streams.run_once(streams.counters(streams.follow_table(spark, path, schema), "event_type"), "counts", "complete")
    assert {(r.event_type, r.total) for r in got.collect()} == {(r.event_type, r["count"]) for r in df.groupBy("event_type").count().collect()}
    timed = streams.run_once(streams.windowed_counts(streams.follow_table(spark, path, schema), "ts", "1 hour", ["event_type"], late="1000 days"), "hours", "complete")
    want = df.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").count()
    assert {(r.window.start, r.event_type, r.n) for r in timed.collect()} == {(r.w.start, r.event_type, r["count"]) for r in want.collect()}


def test_last_records(spark, tmp_path):
    df, path = folder(spark, tmp_path, parts=1)
    schema = df.schema.simpleString()[7:-1].replace(":", " ")
    got = streams.run_once(streams.last_records(streams.follow_table(spark, path, schema), "event_type", "event_id", "value", 3), "lasts")
    rows = sorted((r.event_type, r.event_id, r.value) for r in df.collect())
    want = {}
    for kind in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == kind]
        for i, (_, event_id, _) in enumerate(mine):
            last = [v for _, _, v in mine[max(0, i - 2) : i + 1]]
            want[event_id] = (round(sum(last), 6), len(last))
    assert {r.event_id: (round(r.window_sum, 6), r.window_size) for r in got.collect()} == want


def test_lines_that_come_in(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("one\n\ntwo\n")
    got = streams.run_once(streams.follow_lines(spark, str(tmp_path / "logs")), "lines")
    assert sorted(r.line for r in got.collect()) == ["one", "two"]


def chunk_lines():
    """Lines of three files, many of one, with stack traces, delimiters, blank and null lines."""
    rng = random.Random(4)
    rows = []
    for name, n in (("a", 150), ("b", 12), ("c", 1)):
        rows += [(name, i, rng.choice(["2024 start", "  at x", "  at y", "---", " --- ", "", None])) for i in range(1, n + 1)]
    return rows


@pytest.mark.parametrize("how", [{"start": "^2024"}, {"delimiter": "---"}])
def test_streamed_chunks_are_those_of_the_batch(spark, tmp_path, how):
    rows = chunk_lines()
    ends = {name: max(i for n, i, _ in rows if n == name) for name in "abc"}
    schema = "file string, n long, line string, last boolean"
    folder = tmp_path / "in"
    for at in range(0, 160, 40):  # files of lines come one after another, each one batch
        some = [(f, i, t, i == ends[f]) for f, i, t in rows if at < i <= at + 40]
        spark.createDataFrame(some + some[:3], schema).repartition(1).write.mode("append").parquet(str(folder))
    stream = streams.chunks(streams.follow_table(spark, str(folder), schema, max_files=1), "file", "n", end="last", timeout=None, **how)
    got = streams.run_once(stream, f"chunks_{next(iter(how))}", checkpoint=str(tmp_path / "checkpoint"))
    stored = spark.createDataFrame([(f, i, t or "") for f, i, t in rows], "file string, n long, line string")
    batch = chunking.chunked(stored, **how, order="n", by=["file"])
    columns = ["file", "start_line", "n_lines", "text"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect()))
    assert got.where("not whole").count() == 0


def test_streamed_chunks_after_a_time_and_in_parts(spark, tmp_path):
    schema = "file string, n long, line string"
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    spark.createDataFrame([("a", i, "2024" if i == 1 else " at") for i in range(1, 8)], schema).repartition(1).write.parquet(folder)
    lines = streams.follow_table(spark, folder, schema)
    query = streams.chunks(lines, "file", "n", start="2024", timeout="1 second", most_lines=3).writeStream.format("memory").queryName("parts").outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(60):
            time.sleep(1)
            if spark.table("parts").where("whole").count():
                break
        assert [tuple(r) for r in spark.table("parts").orderBy("start_line").collect()] == [("a", 1, 3, "2024\n at\n at", False), ("a", 4, 3, " at\n at\n at", False), ("a", 7, 1, " at", True)]
    finally:
        query.stop()
    with pytest.raises(ValueError, match="either"):
        streams.chunks(lines, "file", "n")
