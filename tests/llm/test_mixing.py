"""Sources that hold few documents, or one large one, meet their targets to the word."""

import random
from collections import Counter

import pytest

from loglattice.llm import mixing
from loglattice.llm.queries import op3_mixing

DATA = "/root/testdata/sf0.001"


def near_targets(rows):
    taken, target, size, source_size = Counter(), {}, Counter(), {}
    for r in rows:
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source], source_size[r.source] = r.target, r.source_size
        assert 0 <= r.taken <= 2 * r.size
    assert size == Counter(source_size)
    assert all(taken[s] == pytest.approx(t, abs=1) for s, t in target.items()), [(s, taken[s], t) for s, t in target.items()]


@pytest.mark.parametrize("share", [0.3, 1.2, 1.5, 2.5])
def test_few_documents(spark, share):
    rng = random.Random(3)
    rows = [(30 * s + i, "w " * rng.choice([0, 3, 500, 4000, 20_000]), f"s{s}") for s in range(30) for i in range(4)] + [(5000 + i, "long " * 72_000, "two") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    near_targets(mixing.take_words(docs, share=share).collect())


def test_query(spark):
    rows = op3_mixing(spark, DATA).collect()
    of = {r.doc_id: r.source for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    taken, target = Counter(), {}
    for r in rows:
        taken[of[r.doc_id]] += r.taken
        target[of[r.doc_id]] = r.target
    assert all(taken[s] == pytest.approx(t, abs=1) for s, t in target.items())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op3_mixing(spark, DATA).collect()))
