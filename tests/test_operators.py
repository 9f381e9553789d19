"""Record operators, readers, writers, pipelines."""

import random

import pytest
from pyspark.sql import functions as F

from loglattice.operators import chunking, levels, ordering, records
from loglattice.plans.pipeline import Pipeline
from loglattice.sources import readers, writers


def lines(spark, *texts):
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "LINENUM long, line string")


def test_line_numbers_across_splits_and_files(spark, tmp_path):
    rng = random.Random(1)
    want = {}
    for f in range(3):
        text = ["" if rng.random() < 0.1 else f"{f} {i} " + "x" * rng.randrange(60) for i in range(4000)]
        (tmp_path / f"{f}.log").write_text("\n".join(text) + "\n")
        want |= {(f"{f}.log", i + 1): t for i, t in enumerate(text) if t.strip()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = readers.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {(r.FILENAME.rsplit("/", 1)[1], r.LINENUM): r.line for r in got} == want


def test_running_totals_and_trailing_frames(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.randrange(9)) for i in rng.sample(range(10_000), 700)]
    df = spark.createDataFrame(rows, "i long, k string, v long").repartition(5)
    got = {r.i: r.total for r in ordering.running_total(df, F.col("v"), "total", "i", ["k"], slices=16).collect()}
    for k in "ab":
        total = 0
        for i, _, v in sorted(r for r in rows if r[1] == k):
            total += v
            assert got[i] == total
    framed = ordering.trailing(df, 4, "i", {"s": lambda w: F.sum("v").over(w), "n": ordering.window_size(), "p": ordering.back("v", 1)}, block=50).collect()
    ordered = sorted(rows)
    by_id = {r.i: r for r in framed}
    assert len(framed) == len(rows)
    for at, (i, _, _) in enumerate(ordered):
        last = [v for _, _, v in ordered[max(0, at - 3) : at + 1]]
        assert (by_id[i].s, by_id[i].n) == (sum(last), len(last))
        assert by_id[i].p == (last[-2] if at else None)
    with pytest.raises(ValueError):
        ordering.trailing(df, 0, "i", {})


def test_chunks(spark):
    df = lines(spark, "2024 a", " b", "2024 c", " d", "2024 e")
    text = lambda d: [r.text for r in d.orderBy("start_line").collect()]
    assert text(chunking.chunk_lines(df, 2)) == ["2024 a\n b", "2024 c\n d", "2024 e"]
    assert text(chunking.chunk_start(df, "^2024")) == ["2024 a\n b", "2024 c\n d", "2024 e"]
    assert text(chunking.chunk_start(df, "^never")) == ["2024 a\n b\n2024 c\n d\n2024 e"]
    parts = lines(spark, "a", "b", " --- ", "---", "\t---\t", "c")
    assert text(chunking.chunk_delimiter(parts, "---")) == ["a\nb", "c"]
    assert chunking.chunked(df) is df and text(chunking.chunk_lines(df.limit(0), 3)) == []
    with pytest.raises(ValueError):
        chunking.chunked(df, lines=2, start="x")


def test_levels(spark):
    cases = {"ERROR: x": "error", "[warn] x": "warn", "all is info": "info", "x debug y": "debug", "Trace it": "trace", "errors": None, "fatal error warn": "error", "nothing": None, "warning: x": "warn"}
    df = lines(spark, *cases)
    assert {r.line: r.level for r in df.withColumn("level", levels.level_from_text("line")).collect()} == cases
    kept = lambda **o: {r.line for r in levels.filter_levels(df, text="line", **o).collect()}
    assert kept(include=["error", "warn"]) == {"ERROR: x", "[warn] x", "fatal error warn", "warning: x"}
    assert kept(include=["error"], exclude=["error"]) == set()
    assert kept(exclude=["error", "warn", "info", "debug", "trace"]) == {"errors", "nothing"}
    named = spark.createDataFrame([(1, "INFO", None), (2, None, "warn"), (3, None, None)], "i long, level string, lvl string")
    assert [r.i for r in levels.filter_levels(named, include=["Info", "WARN"]).orderBy("i").collect()] == [1, 2]
    assert [tuple(r) for r in levels.level_map(named.withColumn("ts", F.col("i")), "i", width=2).orderBy("row").collect()] == [(0, "1", "iw"), (1, "3", ".")]


def test_templates_fan_out_flatten(spark):
    df = lines(spark, "x 200 1.5 alice!", "none", "9223372036854775808 2.0 bob")
    got = records.extract_vars(df, "{status:int} {time:float} {user:word}").orderBy("LINENUM").collect()
    assert [(r.status, r.time, r.user) for r in got] == [(200, 1.5, "alice"), (None, None, None), (None, None, None)]
    out = records.emit(lines(spark, "a"), F.array(F.lit("b"), F.lit("c"))).orderBy("emission").collect()
    assert [r.line for r in out] == ["a", "b", "c"]
    assert [r.line for r in records.emit(lines(spark, "a"), F.array(F.lit("b")), primary=False).collect()] == ["b"]
    nested = spark.sql("select named_struct('name', 'Ann', 'age', 31) user, array('a', 'b') tags, map('k', 1) m, array() none")
    flat = records.flatten(nested)
    assert flat.columns == ["user.name", "user.age", "tags.0", "tags.1", "m.k"] and tuple(flat.first()) == ("Ann", 31, "a", "b", 1)
    assert records.keys(flat, ["user.age", "x"]).columns == ["user.age"]
    one = records.stats(spark.createDataFrame([("2", "INFO", None), ("1", "warn", None)], "ts string, level string, x string")).first()
    assert tuple(one) == (2, "1", "2", "level,ts", "info,warn")
    assert records.lookup(lines(spark, "a"), {}, "line", "v").first().v is None


def test_exit(spark):
    df = lines(spark, "a", "stop", "b", "stop", "c")
    out = ordering.until_exit(df, F.col("line") == "stop", "LINENUM", message=F.lit("bye")).orderBy("LINENUM").collect()
    assert [r.line for r in out] == ["a", "bye"]
    assert ordering.until_exit(df, F.lit(False), "LINENUM").count() == 5


def test_logfmt(spark):
    cases = {'level=ERROR msg="db down, retry" k= q=""': {"level": "ERROR", "msg": "db down, retry", "k": "", "q": ""}, 'm="say \\"hi\\" \\n \\\\n"': {"m": 'say "hi" \n \\n'}, "a=1 a=2": {"a": "2"}, "no equals here": None, "a=1 bare": None, "u=http://x?a=b": {"u": "http://x?a=b"}, 'a="x\\"\"\"y"': {"a": 'x""y'}, 'a="open b=1': {"a": "open b=1"}, 'a="x"b=2': {"a": "x", "b": "2"}, 'a="\u0001\\q"': {"a": "\u0001\\q"}, "=1": None}
    df = lines(spark, *cases)
    kept = {r.line: r.record for r in readers.parse(df, "logfmt", errors="keep").collect()}
    assert kept == cases
    assert readers.parse(df, "logfmt").count() == 8
    wide = readers.as_columns(readers.parse(lines(spark, "b=1 a=2", "c=3"), "logfmt").drop("line"))
    assert wide.columns == ["LINENUM", "b", "a", "c"]


def test_syslog(spark):
    df = lines(spark, "<165>1 2024-02-01T08:00:00Z h1 app 77 ID1 - text here", "<0>1 t h - - - -", "<192>1 t h a 1 m - x", "Feb  1 08:00:00 h1 app[77]: text", "Feb  1 08:00:00 h1 app: text", "prose")
    got = {r.LINENUM: r for r in readers.parse(df, "syslog").collect()}
    assert sorted(got) == [1, 2, 4, 5]
    one = got[1]
    assert (one.pri, one.facility, one.severity, one.host, one.prog, one.pid, one.msgid, one.msg) == (165, 20, 5, "h1", "app", 77, "ID1", "text here")
    assert (got[2].facility, got[2].severity, got[2].prog, got[2].pid, got[2].msg) == (0, 0, None, None, "")
    assert (got[4].pri, got[4].ts, got[4].pid, got[4].msg) == (None, "Feb  1 08:00:00", 77, "text") and got[5].pid is None
    assert readers.parse(df, "syslog", errors="keep").where("rejected is not null").count() == 2
    with pytest.raises(Exception, match="not syslog"):
        readers.parse(df, "syslog", errors="fail").collect()


def test_access_logs(spark):
    df = lines(
        spark, '10.0.0.9 - bob [01/Feb/2024:08:00:00 +0000] "GET /a HTTP/1.1" 200 12 "http://r/" "UA/1"', '10.0.0.9 - - [t] "POST /l HTTP/1.1" 302 -', '10.0.0.9 - - [t] "POST /x" 200 1', '10.0.0.9 - - [t] "JUNK" 200 1',
        '10.0.0.9 web - ann 443 [t] "GET /q HTTP/2" "a=b" 200 5 "-" "UA" 0.1 0.2', "prose",
    )
    got = {r.LINENUM: r for r in readers.parse(df, "combined").collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert (got[1].user, got[1].method, got[1].path, got[1].proto, got[1].status, got[1].size, got[1].referer, got[1].ua) == ("bob", "GET", "/a", "HTTP/1.1", 200, 12, "http://r/", "UA/1")
    assert (got[2].user, got[2].size, got[2].referer) == (None, None, None)
    assert (got[3].path, got[3].proto) == ("/x", None) and (got[4].method, got[4].path) == ("JUNK", None)
    assert (got[5].host, got[5].port, got[5].query, got[5].referer, got[5].timing) == ("web", 443, "a=b", None, "0.1 0.2")


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,message\nw1,"lost, retry"\nw2,"two\nlines"\nshort\n')
    assert [tuple(r) for r in readers.read(spark, str(tmp_path / "a.csv"), multiline=True).collect()] == [("w1", "lost, retry"), ("w2", "two\nlines")]
    assert [r.rejected for r in readers.read(spark, str(tmp_path / "a.csv"), multiline=True, errors="keep").orderBy("name").collect()] == ["short", None, None]
    (tmp_path / "a.tsv").write_text("a\tb\n1\t2\n")
    assert readers.read(spark, str(tmp_path / "a.tsv")).first().b == "2"
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": {"c": [1, 2]}}\n{"a": nope\n')
    df = readers.read(spark, str(tmp_path / "a.jsonl"))
    assert df.first().a == 1 and df.count() == 1
    (tmp_path / "a.log").write_text("  a   b  \n\nc\n")
    assert [tuple(r) for r in readers.read(spark, str(tmp_path / "a.log"), "fields").orderBy("LINENUM").select("LINENUM", "f1", "f2").collect()] == [(1, "a", "b"), (3, "c", None)]
    assert readers.format_of(["x.JSONL"]) == "jsonl" and readers.format_of(["x.log"]) == "line"
    with pytest.raises(ValueError):
        readers.format_of(["x"], "xml")
    out = str(tmp_path / "out")
    result = writers.write(spark.createDataFrame([("x y", 1)], "a string, b long"), out, "logfmt")
    assert spark.read.text(out).first().value == 'a="x y" b=1' and result.exit_code == 0
    assert writers.write(df.limit(0), str(tmp_path / "none"), "jsonl").exit_code == 2 and writers.RunResult(1, 1).exit_code == 1 and writers.RunResult(0, 0, 7).exit_code == 7
    writers.write(df, str(tmp_path / "csv"), "csv")
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["a", "b.c.0", "b.c.1"]
    with pytest.raises(ValueError):
        writers.formatted(df, "line")
    assert writers.formatted(spark.range(1).select(F.lit("x").alias("a"), F.lit(None).cast("string").alias("b")), "plain").first().line == "x "
    assert spark.range(1).select(writers.coloured(F.lit("m"), F.lit("error"))).first()[0] == "\x1b[31mm\x1b[0m"


def test_pipeline(spark, tmp_path):
    (tmp_path / "x.log").write_text("INFO a 10\nERROR b 15\n\nINFO c 12\nERROR d 20\n")
    p = Pipeline.read(spark, str(tmp_path / "x.log")).extract_vars("{level} {name} {v:int}")
    framed = p.window(3, change=ordering.back("v", 1)).derive(_old="change", change="v - _old").inc("n", when="level = 'ERROR'").frame.orderBy("LINENUM").collect()
    assert [(r.change, r.n) for r in framed] == [(None, 0), (5, 1), (-3, 1), (8, 2)] and "_old" not in framed[0].asDict()
    assert [r.name for r in p.levels(include=["error"]).filter("v > 15").frame.collect()] == ["d"]
    lines_out = p.eval("case when v < 15 then upper(name) end").frame.orderBy("LINENUM").collect()
    assert [r.line for r in lines_out] == ["A", "C"]
    done = p.exit("name = 'c'").end(total="sum(v)").begin(spark.createDataFrame([("head",)], "line string")).result().collect()
    assert [r.part for r in done] == [0, 1, 1, 1, 2] and done[-1].total == 37
    assert p.skip("level = 'INFO'").remove_keys(["line"]).stats().first().records == 2
    assert p.levels(text="line", exclude=["info"]).frame.count() == 2
    whole = Pipeline.read(spark, str(tmp_path / "x.log"), keep_blank=True)
    assert [r.line for r in whole.chunk(lines=2).frame.orderBy("start_line").collect()] == ["INFO a 10\nERROR b 15", "\nINFO c 12", "ERROR d 20"]
    with pytest.raises(ValueError):
        Pipeline(p.frame.drop("line")).chunk(lines=2)
    with pytest.raises(ValueError):
        Pipeline(p.frame).inc("n")
    assert p.keys(["name"]).write(str(tmp_path / "o")).rows == 4


def test_records_that_fail_are_dropped_and_counted(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": "1"}\n{"a": "x"}\n{"a": "0"}\n{bad\n{"a": "4"}\n')
    p = Pipeline.read(spark, str(tmp_path / "x.jsonl"))
    inverse = p.derive(q="1 / cast(a as int)")
    assert sorted((r.a, r.q) for r in inverse.frame.collect()) == [("1", 1.0), ("4", 0.25)]
    assert [r.a for r in p.filter("a > 1").frame.collect()] == ["4"]
    assert sorted(r.line for r in p.eval("cast(a as int) + 1").frame.collect()) == ["1", "2", "5"]
    assert [r.a for r in p.skip("cast(a as int) < 2").frame.collect()] == ["4"]
    done = inverse.filter("q < 1").write(str(tmp_path / "out"), "jsonl")
    assert (done.rows, done.errors, done.read, done.skipped, done.exit_code) == (1, 3, 5, 1, 1)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        Pipeline(p.frame, errors="fail").filter("a > 1").frame.collect()
    kept = Pipeline.read(spark, str(tmp_path / "x.jsonl"), errors="keep").frame
    assert sorted(r.rejected or "" for r in kept.collect())[-1] == "{bad"
    assert p.frame.count() == 4
    assert p.derive(m="map('k', cast(a as int))").frame.count() == 3
    assert p.filter("a = '4'").write(str(tmp_path / "two"), "jsonl", code=7).exit_code == 7


def test_filters_that_cannot_fail_reach_the_files(spark, tmp_path, capsys):
    spark.range(10).withColumn("s", F.lit("x")).write.parquet(str(tmp_path / "t"))
    Pipeline(spark.read.parquet(str(tmp_path / "t"))).filter("id >= 5 and s = 'x'").frame.explain()
    assert "GreaterThanOrEqual(id,5)" in capsys.readouterr().out


def test_writers_count_rows_as_written(spark, tmp_path):
    one = spark.createDataFrame([("two\nlines",)], "line string")
    assert [writers.write(one, str(tmp_path / "o"), "line", mode="append").rows for _ in range(2)] == [1, 1]
    with pytest.raises(ValueError, match="no line format"):
        writers.formatted(one, "parquet")
    df = spark.createDataFrame([("ERR", "a"), ("x", "b")], "level string, msg string")
    assert [r.line for r in writers.formatted(df, "plain", colours=True).collect()] == ["\x1b[31mERR a\x1b[0m", "x b"]
    assert [r.line for r in writers.formatted(lines(spark, "all is info", "-").select("line"), "line", colours=True).collect()] == ["\x1b[32mall is info\x1b[0m", "-"]
    with pytest.raises(ValueError, match="colours"):
        writers.formatted(df, "csv", colours=True)
    with pytest.raises(ValueError, match="common keys"):
        Pipeline(df).common().write(str(tmp_path / "c"), "csv")


def test_begin_and_end_for_each_file(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.log").write_text(f"{name}1\n{name}2\n")
    p = Pipeline.read(spark, str(tmp_path)).begin(spark.createDataFrame([("head",)], "line string"), each=True).end(line="cast(count(1) as string)")
    assert [r.line for r in p.result().collect()] == ["head", "a1", "a2", "2", "head", "b1", "b2", "2"]


def test_level_map_shows_the_timestamp_last_seen(spark):
    df = spark.createDataFrame([(1, "info", "t1"), (2, "warn", None), (3, "info", "t3"), (4, "error", None), (5, None, None), (6, "info", None)], "i long, level string, ts string")
    assert [tuple(r) for r in levels.level_map(df, "i", width=2).orderBy("row").collect()] == [(0, "t1", "iw"), (1, "t3", "ie"), (2, "t3", ".i")]
    texts = lines(spark, "2024-01-02 03:04:05 [error] x", "all is info")
    assert [tuple(r) for r in levels.level_map(texts, "LINENUM", width=9, text="line").collect()] == [(0, "2024-01-02 03:04:05", "ei")]


def test_keys_that_become_columns_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(readers, "MOST_KEYS", 2)
    with pytest.raises(ValueError, match="different keys"):
        readers.as_columns(readers.parse(lines(spark, "a=1 b=2 c=3"), "logfmt"))


def test_slices_by_cuts(spark):
    cuts = [1.0, 2.0, 5.0, 5.5, 9.0, 12.0, 30.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in (0.0, 1.0, 1.5, 5.2, 6.0, 12.5, 31.0)], "x double").select(ordering.place_among(F.col("x"), cuts)).collect()]
    assert got == [0, 0, 1, 3, 4, 6, 7]
    assert spark.range(1).select(ordering.place_among(F.lit(3.0), [])).first()[0] == 0


def test_results_do_not_depend_on_partitions(spark):
    df = spark.range(2000).withColumn("v", F.col("id") % 7)
    one, many = ([tuple(r) for r in ordering.trailing(x, 3, "id", {"s": lambda w: F.sum("v").over(w)}).orderBy("id").collect()] for x in (df.coalesce(1), df.repartition(8)))
    assert one == many


def test_each_step_drops_records_that_fail(spark):
    rows = spark.createDataFrame([(1, "4", [1]), (2, "x", [1, 2]), (3, "0", [1, 2, 3]), (4, None, None)], "n long, line string, tags array<int>")
    p = Pipeline(rows, order="n")
    left = lambda q: sorted(r.n for r in q.frame.select("n").collect())
    assert left(p.derive(x="tags[2]")) == [3, 4]
    assert left(p.derive(v="try_cast(line as int)").derive(x="n div v")) == [1, 2, 4]
    assert left(p.derive(x="-(9223372036854775806 + n)")) == [1]
    assert left(p.inc("k", amount="cast(line as int)")) == [1, 3, 4]
    assert left(p.inc("k", when="cast(line as int) > 0")) == [1, 3, 4]
    assert left(p.exit("cast(line as int) = 0")) == [1, 3]
    assert left(p.exit("n = 3", message="cast(1 / cast(line as int) as string)")) == [1, 2, 4]
    assert left(p.skip("cast(line as int) = 4")) == [3, 4]
    assert left(p.select(x="cast(line as int)")) == [1, 3, 4]
    emitted = p.emit("array(cast(cast(line as int) + 1 as string))").frame
    assert sorted(r.line for r in emitted.where("line is not null").collect()) == ["0", "1", "4", "5"]


def test_what_cannot_fail_is_not_guarded(spark, tmp_path, capsys):
    spark.range(10).select("id", (F.col("id") * 1.5).alias("v"), F.lit("x").alias("s")).write.parquet(str(tmp_path / "t"))
    p = Pipeline(spark.read.parquet(str(tmp_path / "t"))).derive(q="v * (1 - v)", u="upper(s) || 'y'", w="cast(id as double) + v").filter("id >= 5 and s = 'x'")
    p.frame.explain()
    shown = capsys.readouterr().out
    assert "GreaterThanOrEqual(id,5)" in shown and "CollectMetrics" not in shown


def test_a_step_without_records_counts_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("x",), ("1",)], "line string")
    done = Pipeline(rows).derive(x="cast(line as int)").filter("false").write(str(tmp_path / "o"), "logfmt")
    assert (done.rows, done.errors, done.exit_code) == (0, 0, 2)


def test_long_headers_are_refused(spark, monkeypatch):
    monkeypatch.setattr("loglattice.plans.pipeline.MOST_HEADER", 2)
    p = Pipeline(spark.createDataFrame([("f", 1, "a")], "FILENAME string, LINENUM long, line string"), order="LINENUM", by=("FILENAME",))
    head = spark.createDataFrame([("h",), (None,)], "line string")
    assert p.begin(head, each=True).result().count() == 3
    with pytest.raises(ValueError, match="2 rows at most"):
        p.begin(head.union(head), each=True)


def test_ordered_files(spark, tmp_path):
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        ordered_files(spark, tmp_path)
    finally:
        spark.conf.set(coalesce, "true")


def ordered_files(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("LINENUM"), F.concat(F.lit("l"), F.col("id").cast("string")).alias("line"), F.lit("f").alias("FILENAME"))
    p = Pipeline(rows, order="LINENUM", by=("FILENAME",))
    text = lambda path: [x for f in sorted((tmp_path / path).glob("part-*")) for x in f.read_text().splitlines()]
    want = [r.line for r in rows.orderBy("LINENUM").collect()]
    assert p.write(str(tmp_path / "a"), ordered=True).rows == 5000 and text("a") == want
    assert len(list((tmp_path / "a").glob("part-*"))) > 1
    framed = p.begin(spark.createDataFrame([("head",)], "line string")).end(line="cast(count(1) as string)")
    assert framed.write(str(tmp_path / "b"), ordered=True).rows == 5002 and text("b") == ["head", *want, "5000"]
    assert p.write(str(tmp_path / "c"), "csv", ordered=True).rows == 5000
    assert text("c")[0] == "LINENUM,line,FILENAME" and [x.split(",")[1] for x in text("c")[1:]] == want
    p.keys(["LINENUM", "line"]).write(str(tmp_path / "d"), "parquet", ordered=True)
    assert [r.line for f in sorted((tmp_path / "d").glob("part-*")) for r in spark.read.parquet(str(f)).collect()] == want
    with pytest.raises(ValueError, match="order"):
        Pipeline(rows).write(str(tmp_path / "e"), ordered=True)


def test_lines_that_hold_what_stands_between_groups(spark):
    df = lines(spark, '10.0.0.9 - bob [t] "GET /a\x01b HTTP/1.1" 200 12 "r" "U\x01A"', "Feb  1 08:00:00 h app[7]: a\x01b")
    assert [(r.path, r.ua) for r in readers.parse(df, "combined").collect()] == [("/a\x01b", "U\x01A")]
    assert [(r.prog, r.pid, r.msg) for r in readers.parse(df, "syslog").collect()] == [("app", 7, "a\x01b")]
