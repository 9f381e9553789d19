"""The prefix trie, quality rules and lexical search against brute force, with their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from loglattice.llm import lexical_search as ls
from loglattice.llm import prefix_trie as trie
from loglattice.llm import quality_rules as qr
from loglattice.llm.queries import OP11_SQL, OP13_SQL, op12_quality_rules

DATA = "/root/testdata/sf0.001"
TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def in_duckdb(sql, **tables):
    con = duckdb.connect()
    for name, (schema, rows) in tables.items():
        con.execute(f"create table {name} ({schema})")
        if rows:
            con.executemany(f"insert into {name} values ({', '.join('?' * len(rows[0]))})", rows)
    return con.execute(sql)


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(t)] for c, t in own.items()}
    members = defaultdict(list)
    size = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:])
        size[c] = len(seq)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    under, leaves, children = Counter(), Counter(), Counter()
    for p, m in members.items():
        saved = (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
        leaf = max(size[c] for c in m) == len(p)
        if p:
            children[p[:-1]] += 1
        for d in range(len(p) + 1):
            under[p[:d]] += saved
            leaves[p[:d]] += leaf
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], under[p], hashlib.sha256(",".join(str(c) for c in sorted(m) if size[c] == len(p)).encode()).hexdigest()) for p, m in members.items())


def odd_conversations():
    rng = random.Random(3)
    rows = []
    for c in [*range(-7, 60), 700, 701, 704]:
        if rng.random() < 0.1:
            continue
        for t in range(rng.choice([1, 2, 3, 5, 9, 12])):
            rows.append((c, None if rng.random() < 0.05 else t, rng.choice(["user", "bot", None, ""]), rng.choice(["hi", "hi", "yes é", "no", None, "", "a" * 3000])))
    rows += [(10, t, "user", f"turn {t // 2}") for t in range(900)]  # one conversation with most of the rows
    rows += rows[:9] + [(None, 1, "user", "lost"), (33, 4, "user", "x"), (33, 4, "bot", "x"), (33, 4, "user", "w")]
    return rows


def collected(df, columns):
    return sorted((tuple(r) for r in df.select(columns).collect()), key=lambda r: tuple((x is not None, x) for x in r))


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_trie_of_odd_conversations(spark):
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, g1 string").repartition(7)
    got = collected(trie.rebuilt_trie(df), TRIE)
    assert got == ordered(brute_trie(rows))
    assert got == ordered(tuple(r) for r in in_duckdb(f"select {', '.join(TRIE)} from ({OP11_SQL})", conversations=("conv_id bigint, turn bigint, role varchar, text varchar", rows)).fetchall())


def test_trie_stitches_ranges_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 7)
    rows = odd_conversations() + [(c, 0, "user", "same") for c in range(1000, 1400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert len(trie.carries(trie.scanned(df, 0), trie.base_of(0))) > 3  # ranges that begin within a conversation
        assert collected(trie.rebuilt_trie(df), TRIE) == ordered(brute_trie(rows))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_trie_tries_another_base_when_fingerprints_meet(spark, monkeypatch):
    rows = odd_conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    real, asked = trie.base_of, []
    monkeypatch.setattr(trie, "base_of", lambda seed: asked.append(seed) or (real(seed) if seed else 1))  # with 1, order has no effect
    assert collected(trie.rebuilt_trie(df), TRIE) == ordered(brute_trie(rows))
    assert 1 in asked


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie.rebuilt_trie(spark.createDataFrame([], schema)).count() == 0
    assert trie.rebuilt_trie(spark.createDataFrame([(None, 1, "a", "b")], schema)).count() == 0
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(c, 0, "a", "b"), (c, 1, "a", "c")]
    assert collected(trie.rebuilt_trie(spark.createDataFrame(rows, schema)), TRIE) == brute_trie(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    twice = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice)


ODD_TEXTS = [None, "", " \n\t", "a", "a b c a b c", "x " * 60, "a\n\na\n a\na", "é ü\x85   b\x1c#$%", "<b> & | *", "a b c d\n" * 40, "word " * 3 + "\U0001f600" * 4, " ".join(map(str, range(30_000))), "ab cd ef gh ij " * 20_000]


def test_counts_of_texts():
    rng = random.Random(5)
    texts = ODD_TEXTS + [" ".join(rng.choice("abcdé\n#") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    for text in texts:
        assert qr.statistics_of(text)[:5] == brute_counts(text), text


def naive_path(forest, t, row):
    at = 0
    while tuple(forest.below[t, at]) != (at, at):
        at = forest.below[t, at][int(row[forest.by[t, at]] >= forest.cut[t, at])]
    return forest.path[t, at]


def test_forest():
    rng = np.random.default_rng(1)
    rows = np.vstack([rng.normal(0, 1, (2000, 2)), [[9.0, 9.0]]])
    forest = qr.Forest.grow(rows, trees=40, seed=3)
    scores = forest.scores(rows)
    assert scores[-1] == scores.max() and scores[-1] > 0.7 and np.median(scores) < 0.5
    for i in (0, 5, 2000):
        want = 2 ** (-sum(naive_path(forest, t, rows[i]) for t in range(40)) / 40 / forest.usual)
        assert scores[i] == pytest.approx(want)
    assert len(qr.Forest.grow(np.zeros((0, 2))).scores(np.zeros((3, 2)))) == 3
    assert len(set(qr.Forest.grow(np.ones((50, 2))).scores(np.ones((3, 2))))) == 1


def test_thresholds():
    assert qr.threshold_from([(9000, 0, 10), (8000, 1, 1), (3000, 1, 5000)]) == pytest.approx(0.85, abs=1e-3)
    assert qr.threshold_from([(9000, 1, 100), (3000, 0, 10)]) > 1  # the odd ones are good
    assert qr.threshold_from([(9000, 1, 3), (8000, 0, 2), (3000, 1, 5000)]) > 1  # more good than bad would go
    assert qr.threshold_from([]) > 1


def quality_rows():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randint(60, 400))) for _ in range(600)]
    bad = [" ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in t.split()) for t in texts[:40]]
    return [(i, t) for i, t in enumerate(texts)], [(1000 + i, t) for i, t in enumerate(bad)]


def test_quality(spark):
    good, bad = quality_rows()
    odd = [(5000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, good[0][1]), (None, None), (3, good[3][1]), (3, "short")]
    rows = good + bad + odd
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, marks int, symbols string").repartition(5)
    labels = [(i, 1) for i, _ in good[:300]] + [(i, 0) for i, _ in bad[:20]] + [(None, 0), (0, None), (1000, 1), (77_777, 0)]
    found = qr.judge_quality(docs, spark.createDataFrame([(*r, 2) for r in labels], "doc_id long, quality int, kept int"), pool=500).collect()
    assert sorted((str(r.doc_id), *[r[c] for c in qr.COUNTS]) for r in found) == sorted((str(i), *brute_counts(t)) for i, t in rows)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in found)
    kept = {r.doc_id: r.kept for r in found if r.doc_id is not None and r.doc_id != 3}
    assert not any(kept[i] for i, _ in bad) and sum(kept[i] for i, _ in good if i != 3) >= 0.99 * len(good)
    assert not any(r.kept and r.base_failed for r in found)


def test_quality_of_nothing_and_without_labels(spark):
    empty, none = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")
    assert qr.judge_quality(empty, none).count() == 0
    docs = spark.createDataFrame(quality_rows()[0][:50], "doc_id long, text string")
    assert qr.judge_quality(docs, none).count() == 50


def test_quality_query(spark):
    rows = op12_quality_rules(spark, DATA).collect()
    texts = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert sorted((r[0], *r[1:6]) for r in rows) == sorted((r.doc_id, *brute_counts(r.text)) for r in texts)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    judged = [(quality[r.doc_id], r.kept) for r in rows if r.doc_id in quality and not r.base_failed]
    assert sum(kept for q, kept in judged if q) >= 0.98 * sum(1 for q, _ in judged if q)
    assert sum(not kept for q, kept in judged if not q) >= 0.8 * sum(1 for q, _ in judged if not q)


def brute_ranks(docs, items, k=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = [(i, Counter(w), len(w)) for i, t in docs if (w := words(t))]
    n, length = len(counts), sum(x[2] for x in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    asked = defaultdict(Counter)
    for item, text in {*items}:
        asked[item].update(words(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c, size in counts:
            m = 75 + 25 * size * n // length
            scores.append((-sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, q in terms.items() if c[t]), i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(x for x in scores if x[0] < 0)[:k], 1)]
    return ordered(out)


def search_rows():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)] + ["The", "THE", "É", "naïve", "x1"]
    some = lambda k: " ".join(words[min(304, int(rng.paretovariate(0.6)) - 1)] + rng.choice(["", ".", "-"]) for _ in range(k))
    docs = [(i, some(rng.randint(0, 60))) for i in range(700)]
    docs += [(i, docs[i][1]) for i in range(20)] + [(1000 + i, docs[i][1]) for i in range(60)]
    docs += [(None, docs[5][1]), (None, None), (2000, ""), (2001, " .,-"), (2002, "the " * 30_000), (-4, some(20_000))]
    items = [(i, some(rng.randint(1, 40))) for i in range(30)]
    items += [items[0], (1, "naïve the the the"), (None, "x1 naïve"), (90, None), (91, "absent from all"), (92, "")]
    return docs, items


@pytest.mark.parametrize("block, bundle", [(ls.BLOCK, ls.BUNDLE), (64, 4)])
def test_search(spark, monkeypatch, block, bundle):
    monkeypatch.setattr(ls, "BLOCK", block)
    monkeypatch.setattr(ls, "BUNDLE", bundle)
    docs, items = search_rows()
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, item int, block int").repartition(3)
    asked = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, term int")
    columns = ["item_id", "rank", "doc_id", "score"]
    got = collected(ls.lexical_search(frame, asked), columns)
    assert got == brute_ranks(docs, items)
    sql = in_duckdb(f"select item_id, rank, doc_id, score from ({OP13_SQL})", documents=("doc_id bigint, text varchar", docs), benchmark=("item_id bigint, text varchar", items)).fetchall()
    assert got == ordered(tuple(r) for r in sql)


def test_search_prunes_exactly(spark, monkeypatch):
    docs, items = search_rows()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert collected(ls.lexical_search(frame, asked, k=2), ["item_id", "rank", "doc_id", "score"]) == brute_ranks(docs, items, 2)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ls.lexical_search(docs, items).count() == 0 and ls.lexical_search(docs, asked).count() == 0 and ls.lexical_search(some, items).count() == 0
    assert [tuple(r) for r in ls.lexical_search(some, asked).collect()] == brute_ranks([(1, "a b")], [(1, "a b")])
