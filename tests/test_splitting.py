"""CSV and JSON Lines with line numbers, read in splits of a few bytes, against the csv module."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from loglattice.operators import ordering
from loglattice.plans.pipeline import Pipeline
from loglattice.sources import readers, splitting


@pytest.fixture
def small_splits(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


def brute(text):
    """(first line, fields) of each record that has fields."""
    reader, out, before = csv.reader(io.StringIO(text, newline="")), [], 0
    for fields in reader:
        if fields:
            out.append((before + 1, fields))
        before = reader.line_num
    return out


def odd_csv(seed, n):
    rng = random.Random(seed)
    value = lambda: "".join(rng.choice(["a", "b", "é", ",", '"', "\n", " ", "x" * 30]) for _ in range(rng.randrange(6)))
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_MINIMAL)
    writer.writerow(["id", "one", "two"])
    for i in range(n):
        writer.writerow([i, value(), value()])
        if rng.random() < 0.1:
            out.write("\n")
    return out.getvalue()


def test_csv_in_splits(spark, tmp_path, small_splits):
    texts = {f"{name}.csv": odd_csv(seed, n) for seed, (name, n) in enumerate([("a", 150), ("b", 40), ("c", 0), ("d", 1)])}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    df = readers.read(spark, str(tmp_path), "csv", numbered=True)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    got = sorted((r.FILENAME.rsplit("/", 1)[-1], r.LINENUM, r.id, r.one, r.two) for r in df.na.fill("").collect())
    assert got == sorted((name, line, *f) for name, text in texts.items() for line, f in brute(text)[1:])
    plain = readers.read(spark, str(tmp_path), "csv")
    assert plain.columns == ["id", "one", "two"] and sorted(tuple(r) for r in plain.na.fill("").collect()) == sorted(tuple(r[2:]) for r in got)


def test_windows_span_bounded_chunks_of_a_split(spark, tmp_path, monkeypatch):
    """One large split: records of several lines over chunks of four lines, blank lines first, and no window over more lines."""
    monkeypatch.setattr(ordering, "CHUNK_BITS", 2)
    monkeypatch.setattr(splitting, "PART", 300)
    text = "\n" * 9 + odd_csv(7, 120)
    (tmp_path / "a.csv").write_text(text, newline="")
    placed = splitting.placed_lines(spark, [str(tmp_path)]).withColumn("chunk", ordering.chunk_of("place"))
    assert placed.select("block").distinct().count() == 1 and splitting.parts_of(spark, [str(tmp_path)]) > 5
    assert placed.groupBy(*splitting.CHUNK).count().agg(F.max("count")).first()[0] == 4
    df = readers.read(spark, str(tmp_path), "csv", numbered=True)
    assert sorted((r.LINENUM, r.id, r.one, r.two) for r in df.na.fill("").collect()) == sorted((line, *f) for line, f in brute(text)[1:])
    lines = readers.read_lines(spark, str(tmp_path), keep_blank=True)
    assert [r.line for r in lines.orderBy("LINENUM").collect()] == text.split("\n")[:-1]
    for plan in (df, lines):
        windows = [x for x in plan._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x and "place#" in x]
        assert windows and all("chunk#" in x for x in windows)


def test_quotes_within_fields_open_nothing(spark, tmp_path, small_splits):
    rows = "".join(f'{i},5" pipe,"say ""hi""\nto {i}"\n' for i in range(60))
    (tmp_path / "x.csv").write_text("a,b,c\n" + rows)
    got = sorted((int(r.a), r.LINENUM, r.b, r.c) for r in readers.read(spark, str(tmp_path / "x.csv"), numbered=True).collect())
    assert got == [(i, 2 + 2 * i, '5" pipe', f'say "hi"\nto {i}') for i in range(60)]


def test_no_quotes_are_left_to_spark(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,"x,y"\n')
    assert not splitting.has_open_quotes(spark, [str(tmp_path / "x.csv")])
    assert "FileScan csv" in readers.read(spark, str(tmp_path / "x.csv"))._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "y.csv").write_text('a,b\n1,"x\ny"\n')
    assert splitting.has_open_quotes(spark, [str(tmp_path / "y.csv")])


def test_bad_records(spark, tmp_path, small_splits):
    (tmp_path / "x.csv").write_text('\n\na,b\r\n1,2\r\nshort\n3,"never\n' + "".join(f"{i},closed\n" for i in range(40)))
    path = str(tmp_path / "x.csv")
    assert [(r.LINENUM, r.a, r.b) for r in readers.read(spark, path, numbered=True).collect()] == [(4, "1", "2")]
    kept = sorted((r.LINENUM, r.rejected is not None, r.a if r.rejected is None else None) for r in readers.read(spark, path, numbered=True, errors="keep").collect())
    assert kept == [(4, False, "1"), (5, True, None), (6, True, None)]
    with pytest.raises(Exception, match="never closed|MALFORMED|Malformed"):
        readers.read(spark, path, numbered=True, errors="fail").collect()
    (tmp_path / "y.csv").write_text("a,c\n1,2\n")
    with pytest.raises(Exception, match="another header"):
        readers.read(spark, [path, str(tmp_path / "y.csv")], "csv", numbered=True).collect()


def test_lines_after_a_quote_that_is_never_closed_are_all_told(spark, tmp_path, small_splits, monkeypatch):
    monkeypatch.setattr(splitting, "MOST_LINES", 10)
    (tmp_path / "x.csv").write_text('a,b\n1,"never\n' + "".join(f"{i},x\n" for i in range(50)))
    kept = readers.read(spark, str(tmp_path / "x.csv"), numbered=True, errors="keep").collect()
    assert all(r.rejected for r in kept) and sorted(r.LINENUM for r in kept) == [2, *range(12, 53)]


def test_jsonl_is_numbered(spark, tmp_path, small_splits):
    (tmp_path / "x.jsonl").write_text("".join('{"a": %d}\n\n' % i if i % 7 else "{bad\n\n" for i in range(60)))
    rows = readers.read(spark, str(tmp_path / "x.jsonl"), numbered=True).collect()
    assert sorted((r.a, r.LINENUM) for r in rows) == [(i, 2 * i + 1) for i in range(60) if i % 7]
    kept = readers.read(spark, str(tmp_path / "x.jsonl"), numbered=True, errors="keep").where("rejected is not null").collect()
    assert sorted(r.LINENUM for r in kept) == [2 * i + 1 for i in range(0, 60, 7)]
    assert readers.read(spark, str(tmp_path / "x.jsonl")).columns == ["a"]
    (tmp_path / "y.jsonl").write_text('{"LINENUM": 9, "b": 1}\n')
    assert Pipeline.read(spark, str(tmp_path / "y.jsonl")).frame.first().LINENUM == 9


def test_steps_that_need_an_order(spark, tmp_path, small_splits):
    (tmp_path / "x.csv").write_text("k,v\n" + "".join(f'u{i % 3},"{i}\n"\n' for i in range(90)))
    p = Pipeline.read(spark, str(tmp_path / "x.csv")).derive(v="cast(trim(v) as int)")
    rows = p.window(2, last=ordering.back("v", 1)).inc("n", by=["k"]).frame.orderBy("LINENUM").collect()
    assert [(r.v, r.last, r.n) for r in rows] == [(i, i - 1 if i else None, i // 3 + 1) for i in range(90)]
    assert rows[0].LINENUM == 2 and rows[1].LINENUM == 4
    assert Pipeline.read(spark, str(tmp_path / "x.csv"), numbered=False).frame.columns == ["k", "v"]
    assert p.frame.select(F.max("LINENUM")).first()[0] == 180
