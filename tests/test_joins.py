"""As-of joins, interval joins and sessions against brute force, with one key that holds most of the rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loglattice.operators import joins, sessions
from loglattice.streaming import streams


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def timed(seed, n, users=(1, 1, 1, 1, 2, 3, None)):
    """Half of the rows and more are of one user; some times are equal, some missing."""
    rng = random.Random(seed)
    return [(i, rng.choice(users), None if rng.random() < 0.03 else float(rng.randrange(400)), rng.randrange(5)) for i in range(n)]


def brute_asof(left, right, direction, exact, tolerance, by):
    out = []
    for i, user, at, v in left:
        best = None
        for r in right:
            if at is None or r[2] is None or (by and (user is None or r[1] != user)) or (not exact and r[2] == at):
                continue
            d = at - r[2]
            if (direction == "backward" and d < 0) or (direction == "forward" and d > 0) or (tolerance is not None and abs(d) > tolerance):
                continue
            rank = (-abs(d), d, (r[0], r[2], r[3]) if by else r)
            if best is None or rank > best[0]:
                best = (rank, r)
        out.append((i, *((best[1][0], best[1][3]) if best else (None, None))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("slices", [1, 7, None])
@pytest.mark.parametrize("direction", joins.DIRECTIONS)
def test_asof(spark, direction, slices):
    left, right = timed(1, 300), timed(2, 200)
    schema = "id long, user long, at double, v int"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    for exact, tolerance, by in [(True, None, ["user"]), (False, 3.0, ["user"]), (True, 2.0, []), (False, None, [])]:
        got = joins.asof_join(a, b, "at", by=by, tolerance=tolerance, direction=direction, exact=exact, slices=slices)
        assert collected(got.select("id", "id_right", "v_right")) == brute_asof(left, right, direction, exact, tolerance, by), (exact, tolerance, by)


def test_asof_of_times_empty_sides_and_names(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    a = spark.createDataFrame([(1, at(10)), (2, at(500))], "id long, ts timestamp")
    b = spark.createDataFrame([(7, at(5)), (8, at(11))], "id long, time timestamp")
    assert collected(joins.asof_join(a, b, "ts", "time", tolerance=60).select("id", "id_right")) == [(1, 7), (2, None)]
    assert joins.asof_join(a, b.where("false"), "ts", "time").columns == ["id", "ts", "id_right", "time"]
    assert collected(joins.asof_join(a, b.where("false"), "ts", "time").select("id", "time")) == [(1, None), (2, None)]
    assert joins.asof_join(a.where("false"), b, "ts", "time").count() == 0
    with pytest.raises(ValueError, match="twice"):
        joins.asof_join(a.withColumn("id_x", F.lit(1)), b, "ts", "time", suffix="_x")
    with pytest.raises(ValueError, match="direction"):
        joins.asof_join(a, b, "ts", "time", direction="up")


def test_asof_splits_a_key(spark):
    """Of rows that nearly all have one key, no task of the merge gets more than a few slices."""
    rows = spark.range(200_000).select("id", F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(0).alias("user"), (F.col("id") * 7919 % 200_003).cast("double").alias("at"))
    joined = joins.asof_join(rows.where("id % 2 = 0"), rows.where("id % 2 = 1").select("user", "at", F.col("id").alias("other")), "at", by=["user"], slices=64)
    shown = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in shown and "Cartesian" not in shown
    sizes = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in sizes) == 100_000


def spans(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = rng.uniform(-50, 300) if rng.random() < 0.5 else float(rng.randrange(300))
        length = rng.choice([0.0, 0.25, 1.0, 3.0, 16.0, 200.0, -1.0])
        rows.append((i, rng.choice([1, 1, 1, 2, None]), None if rng.random() < 0.03 else start, None if rng.random() < 0.03 else start + length))
    return rows


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("by", [[], ["k"]])
def test_intervals(spark, closed, by):
    left, right = spans(1, 200), spans(2, 150)

    def meet(a, b):
        if None in (a[2], a[3], b[2], b[3]) or (by and (a[1] is None or a[1] != b[1])):
            return False
        if closed:
            return a[2] <= a[3] and b[2] <= b[3] and a[2] <= b[3] and b[2] <= a[3]
        return a[2] < a[3] and b[2] < b[3] and a[2] < b[3] and b[2] < a[3]

    schema = "id long, k long, start double, stop double"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema).withColumnsRenamed({"id": "other", "start": "s", "stop": "e"})
    pairs = joins.interval_join(a, b, ("start", "stop"), ("s", "e"), by=by, closed=closed)
    assert collected(pairs.select("id", "other")) == sorted(((x[0], y[0]) for x in left for y in right if meet(x, y)), key=repr)
    shown = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in shown and "Cartesian" not in shown
    found = {x[0] for x in left if any(meet(x, y) for y in right)}
    options = {"by": by, "closed": closed, "key": ["id"]}
    assert collected(joins.interval_join(a, b, ("start", "stop"), ("s", "e"), how="semi", **options).select("id")) == sorted(((i,) for i in found), key=repr)
    assert collected(joins.interval_join(a, b, ("start", "stop"), ("s", "e"), how="anti", **options).select("id")) == sorted(((x[0],) for x in left if x[0] not in found), key=repr)
    outer = joins.interval_join(a, b, ("start", "stop"), ("s", "e"), how="left", **options)
    assert outer.where("other is null").count() == len(left) - len(found) and outer.count() == pairs.count() + len(left) - len(found)


def test_a_long_span_is_not_copied_to_the_buckets_of_short_ones(spark):
    long = spark.createDataFrame([(0.0, 1e9)], "start double, stop double")
    short = spark.range(1000).select((F.col("id") * 1e6).alias("a"), (F.col("id") * 1e6 + 0.5).alias("b"))
    assert joins.interval_join(long, short, ("start", "stop"), ("a", "b")).count() == 1000
    span = joins._span(long, ("start", "stop"), True)
    assert joins._in_buckets(long.select(span[0].alias("start"), span[1].alias("end"), span[2].alias("level")), F.array("level")).count() <= 2


def test_intervals_refuse_what_makes_no_sense(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0)], "id long, a double, b double")
    with pytest.raises(ValueError, match="key"):
        joins.interval_join(df, df, ("a", "b"), how="anti")
    with pytest.raises(ValueError, match="no way"):
        joins.interval_join(df, df, ("a", "b"), how="outer")
    assert joins.interval_join(df.where("false"), df, ("a", "b")).count() == 0


def brute_sessions(rows, gap):
    out, by = [], {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    for of in by.values():
        n, start, last = 0, None, None
        for r in sorted((r for r in of if r[2] is not None), key=lambda r: r[2]):
            if last is None or r[2] - last > gap:
                n, start = n + 1, r[2]
            last = r[2]
            out.append((r[0], start, n))
        out += [(r[0], None, None) for r in of if r[2] is None]
    return sorted(out, key=repr)


@pytest.mark.parametrize("slices", [1, 5, 100, None])
def test_sessions(spark, slices):
    rows = timed(4, 150) + [(1000 + i, 9, 3.0 * i, 0) for i in range(300)]  # one long session over all slices
    df = spark.createDataFrame(rows, "id long, user long, at double, v int")
    for gap in (0, 3, 25):
        got = sessions.sessionize(df, "at", gap, ["user"], slices=slices).select("id", "session_start", "session_no")
        assert collected(got) == brute_sessions(rows, gap)
    whole = sessions.sessionize(df, "at", 1, slices=slices).select("id", "session_start", "session_no")
    assert collected(whole) == brute_sessions([(i, None, at, v) for i, _, at, v in rows], 1)


def test_sessions_are_those_of_streams(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice([1, 1, 1, 2, 3]), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=60 * rng.randrange(3000))) for _ in range(400)]
    rows.append((1, dt.datetime(2030, 1, 1)))  # moves the watermark past all others
    df = spark.createDataFrame(rows, "user long, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    streamed = streams.run_once(streams.sessions(streams.follow_table(spark, str(tmp_path / "in"), "user long, ts timestamp"), "ts", "10 minutes", ["user"]), "as_stream", "complete")
    batch = sessions.sessions(df, "ts", 600, ["user"])
    want = collected(streamed.select("user", F.col("session.start").alias("s"), (F.col("session.end") - F.expr("interval 10 minutes")).alias("e"), "n"))
    assert collected(batch.select("user", "session_start", "session_end", "n")) == want and len(want) > 50
