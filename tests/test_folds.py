"""Folds against plain Python, however records are dealt out, and reports of runs by step."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loglattice.operators import folds
from loglattice.plans.pipeline import Pipeline


def rows():
    rng = random.Random(2)
    return [(i, rng.choice([1, 1, 1, 1, 2, 3, None]), rng.choice(["a", "b", None]), rng.choice(["x", "y"])) for i in range(3000)]


def plain(fold, of):
    state = fold.init()
    for r in of:
        state = fold.step(state, r)
    return fold.finish(state)


@pytest.mark.parametrize("parts, most", [(1, 10_000), (9, 10_000), (40, 2)])
def test_counters(spark, monkeypatch, parts, most):
    monkeypatch.setattr(folds, "MOST_STATES", most)
    df = spark.createDataFrame(rows(), "id long, k long, a string, b string").repartition(parts)
    fold = folds.counters("a", "b")
    got = {r.k: json.loads(r.s) for r in folds.folded(df, fold, "map<string,map<string,long>>", ["k"], ["a", "b"], "m").select("k", F.to_json("m").alias("s")).collect()}
    assert got == {k: plain(fold, [{"a": r[2], "b": r[3]} for r in rows() if r[1] == k]) for k in (1, 2, 3, None)}
    whole = folds.folded(df, fold, "map<string,map<string,long>>", columns=["a", "b"]).select(F.to_json("state")).collect()
    assert [json.loads(r[0]) for r in whole] == [plain(fold, [{"a": r[2], "b": r[3]} for r in rows()])]


def test_a_fold_of_ones_own(spark):
    """The three largest ids and their mean; the state is a list."""
    top = lambda xs: sorted(xs, reverse=True)[:3]
    fold = folds.Fold(list, lambda s, r: top([*s, r["id"]]), lambda a, b: top(a + b), lambda s: {"largest": s, "mean": sum(s) / len(s)})
    df = spark.createDataFrame(rows(), "id long, k long, a string, b string").repartition(11)
    got = {r.k: (r.state.largest, r.state.mean) for r in folds.folded(df, fold, "largest array<long>, mean double", ["k"], ["id"]).collect()}
    for k in (1, 2, 3, None):
        want = top([r[0] for r in rows() if r[1] == k])
        assert got[k] == (want, sum(want) / 3)
    assert folds.folded(df.where("false"), fold, "largest array<long>, mean double", ["k"], ["id"]).count() == 0


def test_a_footer_of_each_file(spark):
    df = spark.createDataFrame([("f1", 1, "a"), ("f1", 2, "b"), ("f2", 1, "a")], "FILENAME string, LINENUM long, line string")
    made = Pipeline(df, order="LINENUM", by=("FILENAME",)).fold(folds.counters("line"), "map<string,long>", ["line"]).result().collect()
    assert [(r.FILENAME, r.part, r.state) for r in made] == [("f1", 1, None), ("f1", 1, None), ("f1", 2, {"a": 1, "b": 1}), ("f2", 1, None), ("f2", 2, {"a": 1})]


def test_report(spark, tmp_path):
    (tmp_path / "x.log").write_text("INFO a 1\nERROR b x\n\nERROR c 3\nWARN d 4\n")
    p = Pipeline.read(spark, str(tmp_path / "x.log")).reported().extract_vars("{level} {name} {v}").derive(v="cast(v as int)", gone="cast(null as string)").filter("v > 1")
    done = p.write(str(tmp_path / "out"), "jsonl")
    assert [(s.step, s.came, s.dropped, s.wrong, s.left) for s in done.report.steps] == [("input", 4, 0, 0, 4), ("extract_vars", 4, 0, 0, 4), ("derive", 4, 0, 1, 3), ("filter", 3, 1, 0, 2)]
    assert {"level", "name", "v"} <= set(done.report.keys) and "gone" not in done.report.keys and done.report.levels == {"error": 1, "warn": 1}
    assert (done.rows, done.read, done.errors, done.exit_code) == (2, 4, 1, 1)
    assert done.report.frame(spark).count() == 4
    assert Pipeline.read(spark, str(tmp_path / "x.log")).write(str(tmp_path / "plain")).report is None
