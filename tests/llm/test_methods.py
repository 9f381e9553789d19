"""Language ID, licence scans and line dedup against brute force; held-out accuracy and recall."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loglattice.llm import language_id, license_scan
from loglattice.llm.common import table
from loglattice.llm.language_id import LONGEST, Judge, Model, grams_of, words_of

DATA = "/root/testdata/sf0.01"


def letters_in(text):
    return any(c.isalpha() for c in text or "")


def test_words_are_runs_of_letters():
    texts = ["½ ²³", "Ⅷ", "aⅧb x2y _é_", "", "ÀÉ中文", "it's 10€"]
    for text in texts:
        want = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        assert words_of(text) == want
    assert [bool(words_of(t)) for t in texts] == [letters_in(t) for t in texts]


def test_judge_against_brute_force():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(1, 8)))
    texts = {lang: [word() for _ in range(300)] for lang in ("aa", "bb", "cc")}
    counts = Counter()
    for lang, words in texts.items():
        for w in words[:150]:
            counts[lang, 0, w] += 1
            for n in range(1, LONGEST + 1):
                for g in grams_of(w, n):
                    counts[lang, n, g] += 1
    kept = {(n, g): i for i, (n, g) in enumerate(sorted({(n, g) for _, n, g in counts if rng.random() < 0.7}))}
    rows = [(lang, n, g, c) for (lang, n, g), c in counts.items() if (n, g) in kept]
    totals, kinds = Counter(), Counter(n for n, _ in kept)
    for lang, n, _, c in rows:
        totals[lang, n] += c

    def log_share(lang, n, g):
        c = counts[lang, n, g] if (n, g) in kept else 0
        return math.log((c + 0.1) / (totals[lang, n] + 0.1 * (kinds[n] + 1)))

    def score(lang, w):
        if (0, w) in kept:
            return log_share(lang, 0, w)
        for n in range(LONGEST, 0, -1):
            if found := [g for g in grams_of(w, n) if (n, g) in kept]:
                return sum(log_share(lang, n, g) for g in found) / len(found)
        return 0.0

    judge = Judge(Model(rows))
    for _ in range(40):
        text = " ".join(rng.choice([*texts["aa"], *texts["bb"], "12", "zzz", word() + "'" + word()]) for _ in range(rng.randrange(1, 12)))
        want = {lang: sum(score(lang, w) for w in words_of(text)) for lang in texts}
        [(lang, share)] = judge.judge([text])
        if not letters_in(text):
            assert (lang, share) == ("und", 0.0)
            continue
        best = max(want.values())
        assert want[lang] == pytest.approx(best, abs=1e-4)
        assert share == pytest.approx(1 / sum(math.exp(x - best) for x in want.values()), abs=1e-4)


def test_languages_of_held_out_documents(spark):
    docs = table(spark, DATA, "documents")
    got = language_id.identify_languages(docs).join(docs.select(F.col("doc_id"), "lang", "text"), "doc_id").collect()
    held = [r for r in got if r.held_out and r.lang and letters_in(r.text)]
    assert len(held) > 150 and sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all((r.lang_pred == "und") == (not letters_in(r.text)) and 0 <= r.score <= 1 for r in got)


def test_ties_repeated_rows_and_rare_languages(spark):
    rows = [(i, "gato perro casa" if i % 2 else "chat chien maison", "es" if i % 2 else "fr", "x") for i in range(40)] + [(100 + i, "qqq www", "xx", "x") for i in range(8)] + [(200 + i, "qqq www", None, "x") for i in range(3)] + [(300, "gato chat", None, None), (301, "Ⅷ ½", None, None)]
    got = language_id.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add((r.lang_pred, r.score))
    assert len(got) == len(rows) and all(len(x) == 1 for x in by_id.values())
    assert by_id[200] == by_id[201] == by_id[202] and {x for x, _ in by_id[200]} == {"xx"}
    assert {x for x, _ in by_id[300]} == {"es"} and by_id[301] == {("und", 0.0)}


def altered(rng, words, share):
    """words with a share of them replaced, left out or preceded by another."""
    out = []
    for w in words:
        r = rng.random()
        out += [rng.choice(["stone", "river"])] if r < share / 3 else [] if r < 2 * share / 3 else [rng.choice(["cloud", "tree"]), w] if r < share else [w]
    return out


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_words_in_order_against_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        places = {}
        for i, w in enumerate(a):
            places[w] = places.get(w, 0) | 1 << i
        assert license_scan.in_order(places, len(a), b) == longest_common(a, b)


def test_altered_notices_against_brute_force():
    """Notices of which words are replaced, left out and put in: found where brute force over all windows finds them."""
    rng = random.Random(6)
    prose = [rng.choice(["red", "the", "of", "license", "software", "green", "version", "to", "and", "house"]) for _ in range(3000)]
    scanner = license_scan.Scanner(Counter({w.encode(): 900 for w in ("the", "of", "to", "and", "software", "license")}), 1000)
    found = wanted = clean = 0
    for k in range(240):
        template = license_scan.TEMPLATES[k % len(license_scan.TEMPLATES)]
        words = template.text.split()
        notice = altered(rng, words, rng.choice((0.0, 0.1, 0.2)))
        at = rng.randrange(2500)
        text = [*prose[at : at + 60], *notice, *prose[at + 60 : at + 130]]
        phrases = all(f" {p} " in f" {' '.join(notice)} " for p in template.phrases)
        holds = phrases and longest_common(words, notice) >= license_scan.LEAST_COVERED * len(words)
        labels = scanner(" ".join(text))[5].split(",")
        wanted += holds
        found += holds and template.label in labels
        clean += scanner(" ".join(prose[at : at + 200]))[5] == ""
    assert wanted > 100 and found >= 0.95 * wanted and clean == 240


def test_licences_in_long_and_repeated_texts(spark):
    notice = "This work is licensed under the GNU General Public License, version 3."
    long = "x " * 200_000 + notice + " y" * 1000
    rows = [(1, long), (2, long), (2, long), (3, None), (4, notice * 2)]
    got = license_scan.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.labels for r in sorted(got, key=lambda r: r.doc_id)] == ["gpl-3", "gpl-3", "gpl-3", "", "gpl-3"]
    assert {r.n_words for r in got if r.doc_id == 2} == {200_000 + 12 + 1000}
