"""The search for links within groups, in one block and in many, against brute force; recall of near duplicates."""

import random
from collections import defaultdict

import numpy as np
import pytest

from loglattice.llm import minhash_dedup
from loglattice.llm.components import connected_components, links_within


def numbers():
    """Numbers that differ by one at most are similar. A class of its own, as executors can't import this file."""

    class Numbers:
        columns = ("value",)

        def __init__(self, values):
            self.values = np.array(values)

        def like(self, i, others):
            return others[abs(self.values[others] - self.values[i]) <= 1]

    return Numbers


def classes(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def groups_of(seed):
    """(key, id, value): a chain, a group of copies, one similar pair among many, all different, and a mixture."""
    rng = random.Random(seed)
    rows = [(0, i, i) for i in range(80)] + [(1, 100 + i, 0) for i in range(200)] + [(2, 300 + i, 5 * i) for i in range(2000)] + [(2, 2300, 5 * 1990 + 1)]
    rows += [(3, 2400 + i, 3 * i) for i in range(30)] + [(4, 2500 + i, rng.choice([0, 0, 0, rng.randrange(300)])) for i in range(150)] + [(5, 2700, 1), (5, 2701, 2), (6, 2800, 1)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [10_000, 700, 60])
def test_links_within_blocks_find_every_component(spark, block):
    rows = groups_of(3)
    members = spark.createDataFrame([(k, i, v, 1) for k, i, v in rows], "key long, id long, value long, n_bytes long")
    links, settled = links_within(members, numbers(), block)
    assert settled == (block == 10_000)
    by_key = defaultdict(list)
    for k, i, v in rows:
        by_key[k].append((v, i))
    similar = [(i, j) for g in by_key.values() for n, (v, i) in enumerate(sorted(g)) for w, j in sorted(g)[n + 1 : n + 300] if abs(v - w) <= 1]
    want = classes(similar, [i for _, i, _ in rows])
    assert len(links.collect()) < 5 * len(rows)  # links, not pairs
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert {i: got.get(i, i) for _, i, _ in rows} == want
    if settled:
        assert {(r.a, r.b) for r in links.collect()} == {(c, i) for i, c in want.items() if i != c}


def test_no_links_in_an_empty_table(spark):
    members = spark.createDataFrame([], "key long, id long, value long, n_bytes long")
    assert links_within(members, numbers(), 10)[0].count() == 0


def brute_classes(rows):
    sets = {i: minhash_dedup.shingles_of(minhash_dedup.hashes_of(t or "")) for i, t in rows}
    ids = sorted(sets)
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a][0]) and len(sets[b][0]) and minhash_dedup.similarity(sets[a], sets[b]) >= 0.8]
    return classes(pairs, ids), pairs


def varied(seed, n, share):
    """n texts; most are another one with a share of its words replaced, some of them repeated."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    base = [word() for _ in range(150)]
    texts = []
    for i in range(n):
        words = [word() if rng.random() < share else w for w in base]
        if i % 7 == 0:
            words = [word() for _ in range(60)]
        if i % 11 == 0:
            words += words[:40]
        texts.append(" ".join(words))
    return list(enumerate(texts))


@pytest.mark.parametrize(("sketch_block", "text_block"), [(400_000, 16_000_000), (2_000, 60_000)])
def test_near_duplicates_against_brute_force(spark, sketch_block, text_block, monkeypatch):
    """Copies at similarities around the threshold, so that a group falls into many classes."""
    rows = varied(1, 120, 0.012) + [(200 + i, t) for i, t in varied(2, 60, 0.03)] + [(400, None), (401, "")]
    want, pairs = brute_classes(rows)
    assert len(pairs) > 300 and len(set(want.values())) > 60
    whole = minhash_dedup.classes_of
    monkeypatch.setattr(minhash_dedup, "classes_of", lambda *a: whole(*a, sketch_block, text_block))
    got = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # a link is missed with a probability of a few in ten thousand; a class found holds no other documents
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.98 * len(pairs)
    assert all(want[i] == want[c] for i, c in got.items())


def test_repeated_ids_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(200))
    other = text.replace("w100 ", "x ")
    rows = [(None, text)] * 40 + [(1, text)] * 30 + [(None, other)] * 20 + [(1, other), (2, "else")]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == 2
    assert sorted(r.class_size for r in got) == [1] + [91] * 91


def test_recall_of_near_duplicates_in_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want, pairs = brute_classes([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(docs).collect()}
    assert len(pairs) > 5 and sum(got[a] == got[b] for a, b in pairs) >= 0.98 * len(pairs)
    assert all(want[i] == want[c] for i, c in got.items())
