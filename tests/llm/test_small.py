"""Edge cases of every operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loglattice.llm import components, exact_dedup, katz_lm, language_id, license_scan, line_dedup, minhash_dedup, mixing, packing, topk_search, url_filter
from loglattice.llm.components import connected_components, linked

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PATH = public_tokenizers.path("word_bpe_49k.json")
CLASHES = ("row", "row_id", "copies", "text_key", "id", "tk", "size", "key", "score", "node", "kept", "digest", "a.b")


def prose(seed, n=120):
    rng = random.Random(seed)
    return " ".join(rng.choice(["red", "green", "blue", "stone", "river", "cloud", "tree", "house", "road", "light"]) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = prose(1)
    words = base.split()
    words[50] = "changed"
    return [
        (1, base, "en", "b", 1),
        (2, base, "en", "b", 1),
        (3, base + "  ", "en", None, 1),
        (4, " ".join(words), "en", "a", 1),
        (5, prose(2), "fr", "a", 1),
        (6, None, None, None, None),
        (7, "", "en", "a", 0),
        (8, " \n\t ", "en", "c", 4),
        (None, prose(3), "de", "c", 1),
        (9, "one two", "en", "b", 7),
        (9, "one two", "en", "b", 7),
        (10, prose(4, 30_000), "fr", "a", 1),
        (11, "\u0130\u03a3 %% !! 123", None, "a", 1),
    ]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(1) for c in CLASHES})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_dedup(docs, rows, empty):
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    groups = Counter(bare(r[1]) for r in rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[1][0].keep_id == 3 and not by_id[1][0].kept and by_id[3][0].kept
    assert by_id[6][0].group_size == 3 and by_id[6][0].keep_id == 8
    assert sorted(r.kept for r in by_id[9]) == [False, True]
    assert sum(r.kept for r in got) == len(groups)
    assert {r.text_sha256 for r in got} == {hashlib.sha256(t.encode()).hexdigest() for t in groups}
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.drop_exact_copies(empty).count() == 0


def test_near_duplicates(docs, rows, empty):
    got = minhash_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    class_of = {r.doc_id: r.class_id for r in got}
    assert class_of[1] == class_of[2] == class_of[3] == class_of[4] == 1
    assert class_of[5] == 5 and class_of[6] == 6 and class_of[7] == 7 and class_of[None] is None
    assert sum(r.kept for r in got) == 9
    assert minhash_dedup.near_duplicates(empty).count() == 0
    left = minhash_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 5, 6, 7, 8, 9, 10, 11]


def weighted(seed, n=200):
    rng = np.random.default_rng(seed)
    ids = np.unique(rng.integers(0, 2**62, n).astype("u8"))
    return ids, rng.integers(1, 5, len(ids)).astype("f8")


def test_signatures_estimate_probability_jaccard():
    x = weighted(1)
    y = (x[0].copy(), x[1].copy())
    y[1][:60] += 3
    y = (y[0][20:], y[1][20:])
    exact = 0.0
    wx, wy = dict(zip(*x, strict=True)), dict(zip(*y, strict=True))
    for i in wx.keys() & wy.keys():
        exact += 1 / sum(max(wx.get(j, 0) / wx[i], wy.get(j, 0) / wy[i]) for j in wx.keys() | wy.keys())
    assert minhash_dedup.similarity(x, y) == pytest.approx(exact)
    s = minhash_dedup.signatures([x, y, x], 2000)
    assert (s[0] == s[2]).all()
    assert (s[0] == s[1]).mean() == pytest.approx(exact, abs=0.05)


def test_chain_of_near_copies_is_one_class(spark):
    """Neighbours are similar, ends are not; and one text is everywhere."""
    words = prose(7, 200).split()
    chain = []
    for i in range(12):
        chain.append(" ".join(words))
        for k in range(3):
            words[(15 * i + 5 * k) % 200] = f"new{i}{k}"
    df = spark.createDataFrame([(i, t) for i, t in enumerate(chain)] + [(100 + i, chain[0]) for i in range(300)], "doc_id long, text string")
    got = minhash_dedup.near_duplicates(df).collect()
    assert {r.class_id for r in got} == {0} and {r.class_size for r in got} == {312}


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(300, i) for i in range(301, 400)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


def links_of(spark, buckets, similar):
    """Links that linked() finds, where similar are the pairs that hold."""
    held = spark.createDataFrame(sorted(similar), "a long, b long")
    return {(r.a, r.b) for r in linked(spark.createDataFrame([(*x, 1, 1) for x in buckets], "key long, id long, rank long, size long"), lambda pairs: pairs.join(held, ["a", "b"], "left_semi")).collect()}


def test_links_after_a_round_without_new_pairs(spark):
    """The leader is like no one, so that its round repeats; the other two are similar."""
    assert links_of(spark, [(0, 1), (0, 2), (0, 3)], {(2, 3)}) == {(2, 3)}


def test_pairs_of_a_small_bucket_are_made_at_once(spark):
    """Buckets of few members that are unlike take one search, and none of their members is led again."""
    asked = []

    def verify(pairs):
        asked.append({(r.a, r.b) for r in pairs.collect()})
        return pairs.limit(0)

    linked(spark.createDataFrame([(k, i, 1, 1) for k, ids in enumerate(([1, 2, 3], [3, 4, 5, 6], [7])) for i in ids], "key long, id long, rank long, size long"), verify)
    assert [x for x in asked if x] == [{(1, 2), (1, 3), (2, 3), (3, 4), (3, 5), (3, 6), (4, 5), (4, 6), (5, 6)}]


def test_links_in_a_crowded_bucket(spark, monkeypatch):
    """Pairs that share one crowded bucket only, and of which none is ever led by the other's component."""
    monkeypatch.setattr(components, "CROWDED", 2)
    similar = {(i, i + 1) for i in range(10, 40, 2)}
    assert links_of(spark, [(0, i) for i in [1, *range(10, 42)]], similar) >= similar
    pairs = components._rest(spark.createDataFrame([(k, i, i // 3, 1) for k in (0, 1) for i in range(20)], "key long, id long, component long, size long"), lambda a, b: F.lit(True)).collect()
    assert sorted((r.a, r.b) for r in pairs) == [(a, b) for a in range(20) for b in range(a + 1, 20) if a // 3 != b // 3]


def test_links_in_a_bucket_cut_by_size(spark):
    """Sizes at the ratio and across the edges of classes; what is too far apart is never held against each other."""
    sizes = [10 + i for i in range(60)] * 2
    held = {(i, j) for i, a in enumerate(sizes) for j, b in enumerate(sizes) if i < j and min(a, b) >= 0.8 * max(a, b) and (i + j) % 7 == 0}
    asked = []

    def verify(pairs):
        asked.extend((r.a, r.b) for r in pairs.collect())
        return pairs.join(spark.createDataFrame(sorted(held), "a long, b long"), ["a", "b"], "left_semi")

    got = {(r.a, r.b) for r in linked(spark.createDataFrame([(0, i, 1, n) for i, n in enumerate(sizes)], "key long, id long, rank long, size long"), verify, 0.8).collect()}
    root = list(range(len(sizes)))
    for i, j in held:
        old, new = max(root[i], root[j]), min(root[i], root[j])
        root = [new if x == old else x for x in root]
    mine = list(range(len(sizes)))
    for i, j in got:
        old, new = max(mine[i], mine[j]), min(mine[i], mine[j])
        mine = [new if x == old else x for x in mine]
    assert got <= held and mine == root
    assert all(min(sizes[a], sizes[b]) >= 0.8 * max(sizes[a], sizes[b]) for a, b in asked)


def test_edit_distance_between_like_ends(spark):
    rng = random.Random(3)
    pairs = [tuple(" ".join(rng.choices(["a", "bb", "ccc"], k=rng.randrange(1, 9))) for _ in range(2)) for _ in range(300)] + [("a", "a"), ("a b", "a"), ("a", "b a")]
    df = spark.createDataFrame(pairs, "p string, q string").select("p", "q", F.split("p", " ").alias("wa"), F.split("q", " ").alias("wb"))
    got = df.select("p", "q", F.inline(F.array(line_dedup.between("wa", "wb")))).select(F.levenshtein("p", "q").alias("whole"), F.levenshtein("x", "y").alias("rest"), "p", "q", "x", "y").collect()
    assert len(got) == len(pairs) and all(r.rest == r.whole for r in got)


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://a.com", "http://A.COM/x", "http://com/x", "http://example.com/en/1", "http://www.example.com/en/1?q", "http://x.www.example.com/en/", "http://wwwexample.com/en/", "http://a.net/es/1", "http://a.net/de/", "https://b.net:80/fr/", "http://a.org/#x://b", "http://example.com./en/"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(100 + i, "http://hot.net/fr/x") for i in range(500)], "page_id long, url string").withColumns({"host": F.lit(1), "slot": F.lit(2), "verdict": F.lit(3)})
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), (None, "/", "block"), ("", "/", "block")]

    def expected(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
        fits = [(h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
        return host, path, rule, verdict

    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got == {r.page_id: expected(r.url) for r in pages.select("page_id", "url").collect()}
    assert url_filter.judge_urls(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def targets(sizes, share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        of = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and weight[s] * rest / of > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else weight[s] * rest / of for s in names}
        full |= over


def test_mixing(docs, rows, empty, spark):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want = targets(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert mixing.mix_sources(empty).count() == 0
    many = spark.createDataFrame([(i, prose(i, 5 + i % 40), "s" if i % 3 else "t") for i in range(2000)], "doc_id long, text string, source string")
    first, again = (sorted((r.doc_id, r.taken) for r in mixing.mix_sources(x).collect()) for x in (many, many.repartition(7)))
    assert first == again
    close = Counter()
    for r in mixing.mix_sources(many).collect():
        close[r.source, r.target] += r.taken
    assert all(abs(n - t) <= 3 for (_, t), n in close.items())
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in got)


@pytest.mark.parametrize("shared", [2, katz_lm.SHARED])
def test_katz_model_matches_brute_force(docs, rows, empty, shared):
    out = katz_lm.score_documents(docs, chunk=500, pairs=300, hot=40, shared=shared).collect()
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 10 == 0 for r in rows]
    uni, bi = Counter(), Counter()
    for r, h in zip(rows, held, strict=True):
        if not h:
            t = katz_lm.tokens_of(r[1])
            uni.update(t)
            bi.update(zip([None, *t[:-1]], t, strict=True))
    n, v = sum(uni.values()), len(uni)
    of_counts = lambda c: np.array([sum(x == r for x in c.values()) for r in range(1, 7)])
    d1, d2 = katz_lm.discounts(of_counts(uni)), katz_lm.discounts(of_counts(bi))
    share = lambda c, total, d: d[c] * c / total if c <= 5 else c / (total + 1)
    p1 = {w: share(c, n, d1) for w, c in uni.items()}
    unknown = 1 - sum(p1.values())
    after = {}
    for (a, b), c in bi.items():
        after.setdefault(a, {})[b] = c
    size = {a: sum(x.values()) for a, x in after.items()}
    alpha = {a: (1 - sum(share(c, size[a], d2) for c in x.values())) / (1 - sum(p1[b] for b in x)) for a, x in after.items()}
    for a, x in after.items():  # every context sums to one
        assert sum(share(c, size[a], d2) for c in x.values()) + alpha[a] * (unknown + sum(p for w, p in p1.items() if w not in x)) == pytest.approx(1)
    want = []
    for r, h in zip(rows, held, strict=True):
        t = katz_lm.tokens_of(r[1])
        base = sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        score = sum(math.log10(share(bi[a, b], size[a], d2) if bi[a, b] else alpha.get(a, 1) * p1.get(b, unknown)) for a, b in zip([None, *t[:-1]], t, strict=True))
        want.append((r[0], h, len(t), sum(uni[w] > 0 for w in t), n, base, score))
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    for got, exp in zip(sorted(map(tuple, out), key=key), sorted(want, key=key), strict=True):
        assert got[:5] == exp[:5]
        assert got[5] == pytest.approx(exp[5]) and got[6] == pytest.approx(exp[6])
    assert katz_lm.score_documents(empty).count() == 0


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    got = packing.packed_pieces(docs, PATH).collect()
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        for k, i in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[i : i + 2048], "<u4")
            want[doc_id, k, i, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= packing.lower_bound(np.array([r.length for r in got])) + 1
    assert packing.packed_pieces(empty, PATH).count() == 0


@pytest.mark.parametrize("text", ["\u0130STANBUL \u03a3\u0391\u03a3 <|ENDOFTEXT|> x<|endoftext|>y", "\u00b2\u00b3 \u00bd it's WE'LL don't 123 a_b __ \u00e9\u0301 \u00e9", "a\x1cb c\x85d e\xa0f\u201cq\u201d", "\u00aa\u00ba \u00b5\u00df \u00ff\u0178 'S 'tis", "\u4e2d\u6587 \U0001f600 na\u00efve"])
def test_tokenizer_agrees(text):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    assert np.frombuffer(next(packing.tokenizer_at(PATH)([text])), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_tokenizer_agrees_on_random_texts(monkeypatch):
    """All kinds of characters next to each other, many texts at once; and texts cut in parts."""
    from tokenizers import Tokenizer

    whole, mine = Tokenizer.from_file(PATH), packing.WordTokenizer(PATH)
    rng = random.Random(8)
    parts = ["'", "''", "s", "t", "re", "ve", "ll", "d", "m", "a", "\u00e9", "\u00df", "\u00c3", "\u00a9", "1", "2", "_", "!", ".", " ", "\n", "\t", "<", "|", "\u00c4", "\u00b9", "\x85", "\u2019", "\u4e2d", "\x0b", "\x1c", "\u00aa", "-"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(14))) for _ in range(5000)]
    ids = lambda text: whole.encode(text, add_special_tokens=False).ids
    assert [np.frombuffer(x, "<u4").tolist() for x in mine(texts)] == [ids(t) for t in texts]
    monkeypatch.setattr(packing, "AT_ONCE", 50)
    long = [" ".join("".join(rng.choices("abc's\u00e91.", k=rng.randrange(1, 9))) for _ in range(300)), "a" * 500 + " b", "", "  "]
    assert [np.frombuffer(x, "<u4").tolist() for x in mine(long)] == [ids(t) for t in long]


def test_what_is_remembered_is_bounded():
    asked = []
    known = packing.Remembered(lambda w: asked.append(w) or w.encode(), most=4)
    assert [known[w] for w in "abcabdc"] == [w.encode() for w in "abcabdc"] and asked == ["a", "b", "c", "d"] and len(known) <= 2


def test_packing_bounds():
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 2049, 500), np.full(30, 1025), np.array([1024] * 10), rng.integers(600, 900, 400), np.array([], int)):
        bins, places, fills = packing.best_fit_decreasing(lengths)
        assert (fills <= 2048).all() and fills.sum() == lengths.sum()
        assert packing.lower_bound(lengths) <= len(fills)
    assert packing.lower_bound(np.full(30, 1025)) == 30 and packing.lower_bound(np.full(31, 683)) == 16


def test_packing_exchanges_between_groups(spark):
    rng = np.random.default_rng(9)
    pieces = spark.createDataFrame([(i, int(n)) for i, n in enumerate(rng.integers(1, 2049, 3000))], "pid long, length long")
    pieces_length = dict(pieces.collect())
    got = packing.pack(pieces, group=1000).collect()
    assert len(got) == 3000 and len({r.pid for r in got}) == 3000
    used = len({r.sequence_id for r in got})
    assert used <= 1.01 * packing.lower_bound(np.array([r.length for r in pieces.collect()]))
    fills = Counter()
    for r in got:
        fills[r.sequence_id] += pieces_length[r.pid]
    assert max(fills.values()) <= 2048 and {r.sequence_id for r in got if r.offset == 0} == set(fills)
    # a sequence with a gap is in a group whose bins are counted and bounded
    assert all(r.bins >= r.bound > 0 for r in got)


def test_packing_ends_when_nothing_is_gained(spark):
    """No two pieces fit together: every group is certified at once."""
    pieces = spark.createDataFrame([(i, 1100 + i % 7) for i in range(900)], "pid long, length long")
    got = packing.pack(pieces, group=100).collect()
    assert len({r.sequence_id for r in got}) == 900 and all(r.bins == r.bound for r in got)


def test_topk(spark):
    rng = np.random.default_rng(2)
    vectors = [rng.normal(size=20).tolist() for _ in range(300)]
    data = [(i, vectors[i % 3] if i % 4 == 0 else v) for i, v in enumerate(vectors)] + [(1000, None), (None, vectors[0]), (1050, [1.0]), (1100, [None] * 20), (50, vectors[50])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumns({"code": F.lit(1), "rank": F.lit(1), "block": F.lit(1)})
    got = topk_search.nearest(df, k=7).collect()
    good = [(i, np.array(v) >= 0) for i, v in data if i is not None and v is not None and len(v) == 20 and v[0] is not None]
    want = []
    for q, code in {i: c for i, c in good if i % 50 == 0}.items():
        best = sorted((int((code != c).sum()), i) for i, c in good)[:7]
        want += [(q, n + 1, i, d) for n, (d, i) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.distance) for r in got) == sorted(want)
    assert topk_search.nearest(df.limit(0)).count() == 0


def test_topk_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    data = [(i, rng.normal(size=64).tolist()) for i in range(2000)]
    for name, size in (("ROWS_BLOCK", 300), ("PIECE", 70), ("QUERY_BLOCK", 9), ("TASK_QUERIES", 15)):
        monkeypatch.setattr(topk_search, name, size)
    got = sorted((r.query_id, r.distance, r.vec_id) for r in topk_search.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect())
    codes = np.array([v for _, v in data]) >= 0
    want = [(q, *x) for q in range(0, 2000, 50) for x in sorted((int((codes[q] != codes[i]).sum()), i) for i in range(2000))[:10]]
    assert got == sorted(want)


def test_licences(spark, empty):
    texts = [None, "", "Released under the MIT License. Under the MIT license", "under the  MIT-License, under\nthe mit license", "Licensed under the Apache License, Version 2.0.", "under the mit licenses", "CC BY-NC 4.0", "This work is licensed under the GNU General Public License, version 3.", "\u00e9mit license", "cc by nc cc by nc", "under the mit"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("labels", F.lit(1))
    got = {r.doc_id: r for r in license_scan.scan_licences(df).collect()}
    for i, text in enumerate(texts):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        places = sorted((k, label) for p, label in license_scan.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        assert (got[i].n_words, got[i].n_base) == (len(words), len(places))
        assert got[i].first_word == (places[0][0] if places else None) and got[i].last_word == (places[-1][0] if places else None)
        assert got[i].base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, got[i].base_labels.split(","))) <= set(got[i].labels.split(",")) and 0 <= got[i].score <= 1
    assert got[7].labels == "gpl-3" and got[5].labels == ""
    assert license_scan.scan_licences(empty).count() == 0


def test_languages(docs, rows, empty, spark):
    got = language_id.identify_languages(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    by_id = {r.doc_id: r for r in got}
    assert by_id[6].lang_pred == by_id[7].lang_pred == by_id[8].lang_pred == "und" and by_id[6].score == 0
    assert language_id.identify_languages(empty).count() == 0
    kept = language_id.drop_unidentified(docs)
    assert kept.columns == docs.columns and not {6, 7, 8} & {r.doc_id for r in kept.collect()}
    unlabelled = spark.createDataFrame([(1, "some text", None, None, 1)], SCHEMA)
    assert language_id.identify_languages(unlabelled).first().lang_pred == "und"


def test_fuzzy_lines(docs, rows, empty, spark):
    got = line_dedup.lines_by_document(docs).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[1][0].n_kept == 1 and by_id[2][0].dropped == [0] and by_id[3][0].dropped == [0]
    assert sorted(r.n_kept for r in by_id[9]) == [0, 1]
    assert by_id[8][0].n_lines == by_id[8][0].n_kept == 2
    assert line_dedup.lines_by_document(empty).count() == 0
    left = line_dedup.drop_repeated_lines(docs)
    assert left.columns == docs.columns and left.count() == len(rows)
    long = prose(11, 400)
    near = " ".join("changed" if i == 200 else w for i, w in enumerate(long.split()))
    df = spark.createDataFrame([(1, "Alpha beta gamma!\n" + long), (2, "alpha  BETA gamma\nquite another line\n" + near), (3, "delta")], "doc_id long, text string")
    kept = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(df).collect()}
    assert kept[1] == "Alpha beta gamma!\n" + long and kept[2].startswith("quite another line") and kept[3] == "delta"


def edited(rng, line, share, vocabulary):
    """The line with that share of its words replaced, one at least."""
    words = line.split()
    for i in rng.sample(range(len(words)), max(1, int(share * len(words)))):
        words[i] = rng.choice(vocabulary)
    return " ".join(words)


def test_fuzzy_lines_against_brute_force(spark):
    """Short and medium lines with changed words: pairs at edit similarity 0.8 in the same class, and none besides."""
    rng = random.Random(21)
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocabulary = ["".join(rng.choices(letters, k=rng.randrange(2, 11))) for _ in range(3000)]
    lines = []
    for n in (1, 1, 2, 2, 3, 4, 6, 8, 10, 15, 20, 26, 30, 50) * 8:
        line = " ".join(rng.choices(vocabulary, k=n))
        lines += [line, edited(rng, line, rng.choice((0, 0.1, 0.15)), vocabulary)]
        at = rng.randrange(len(line))
        lines.append((line[:at] + rng.choice(letters) + line[at + 1 :]).strip())
    lines = list(dict.fromkeys(lines))
    pairs = spark.createDataFrame([(i, a, j, b) for i, a in enumerate(lines) for j, b in enumerate(lines) if i < j and min(len(a), len(b)) >= 0.8 * max(len(a), len(b))], "i long, a string, j long, b string")
    near = pairs.where("5 * levenshtein(a, b) <= greatest(length(a), length(b))").select("i", "j").collect()
    root = list(range(len(lines)))
    for i, j in ((r.i, r.j) for r in near):
        old, new = max(root[i], root[j]), min(root[i], root[j])
        root = [new if x == old else x for x in root]
    rows = line_dedup.lines_by_document(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    dropped = {r.doc_id for r in rows if r.n_kept == 0}
    want = {i for i, x in enumerate(root) if x != i}
    print(f"edit similarity 0.8: {len(near)} pairs; {len(want & dropped)} of {len(want)} lines dropped")
    assert dropped <= want and len(want & dropped) >= 0.97 * len(want) and len(want) > 150
    short = {i for i in want if len(lines[i]) < line_dedup.SHORT and len(lines[root[i]]) < line_dedup.SHORT}
    assert short and short <= dropped


def test_chunk_numbers_do_not_run_over(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(i)) for i in range(40)], "doc_id long, text string").coalesce(1)
    assert katz_lm.chunked(docs, 0, 10, 500).select("chunk").distinct().count() == 8
    monkeypatch.setattr(katz_lm, "TASK_CHUNKS", 7)
    with pytest.raises(Exception, match="over 7 chunks in a task"):
        katz_lm.chunked(docs, 0, 10, 500).count()


def test_lines_without_rare_letters_and_lines_that_repeat_themselves(spark):
    """Long lines of frequent letters only, of which no run starts at an anchor, and of one word many times."""
    rng = random.Random(8)
    common = ["".join(rng.choices("acdeghiklmopqstuwxy", k=6)) for _ in range(60)]
    line = " ".join(common[:40])
    docs = [(1, line), (2, " ".join("aided" if i in (7, 30) else w for i, w in enumerate(common[:40]))), (3, "osas " * 300), (4, "osas " * 280 + "cosa"), (5, " ".join(common[20:60]))]
    rows = line_dedup.lines_by_document(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id for r in rows if r.n_kept == 0} == {2, 4}


def test_pairs_that_cannot_be_near_by_place_are_not_asked_for(spark):
    """A key at one end of one member and at the other of the other; one with several places counts by the nearest."""
    asked = []

    def verify(pairs):
        asked.extend((r.a, r.b) for r in pairs.collect())
        return pairs.limit(0)

    rows = [(0, 1, 1, 100, 0), (0, 2, 1, 100, 10), (0, 3, 1, 100, 80), (1, 4, 1, 100, 5), (1, 4, 1, 100, 70), (1, 5, 1, 100, 75)]
    linked(spark.createDataFrame(rows, "key long, id long, rank long, size long, place int"), verify, 0.8)
    assert sorted(asked) == [(1, 2), (4, 5)]
