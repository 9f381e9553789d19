"""Licence scans by a positional index of rare tokens.

Each template is a licence notice with key phrases that must stand in it. How many documents have each template
word is counted over all documents. A template's rarest places are indexed: so many that a notice which has enough of
the template's words must have some of these. A document looks up its words there; each gives where the template
would start, and postings that agree on the start, up to a few words put in or left out, are intersected. Where
enough agree, the words in order are counted, and a match needs enough of them and every key phrase. One pass counts,
one scans; neither shuffles a text.

Edge cases: a null text counts as empty, with no words and no labels; phrases may overlap and repeat, and each place
counts; words are bytes outside ASCII, digits and letters, in lower case for A-Z; of words that are as rare, the
first by code point counts as rarer; repeated rows are scanned each; an empty table gives an empty result; extra
columns have no effect.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Upper case to lower, what is no word to a space.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Words of a template that must stand in order; postings that must agree, of templates long enough; words by which starts may differ.
LEAST_COVERED, AGREEING, LONG, SHIFT = 0.75, 2, 8, 6


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TO_WORDS).split()


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...]


# The phrases of the contract.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Notices by which licences are commonly declared, and their key phrases.
TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("permission is hereby granted", "free of charge")),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ("apache license version 2",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "version 3 of the license")),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("gpl-2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "version 2 of the license")),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use", "source and binary forms")),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("must retain the above copyright notice", "must reproduce the above copyright notice")),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
)


def found_in(parts: list[bytes], words: list[bytes], at: int) -> bool:
    return words[at : at + len(parts)] == parts


def in_order(places: dict[bytes, int], n: int, words: list[bytes]) -> int:
    """How many of a template's n words stand in words, in order: their longest common subsequence, by bits of a number.

    places: for each word the bits of its places in the template.
    """
    rest = every = (1 << n) - 1
    for w in words:
        hit = rest & places.get(w, 0)
        rest = ((rest + hit) | (rest - hit)) & every
    return n - rest.bit_count()


class Scanner:
    def __init__(self, document_counts: dict[bytes, int], documents: int, templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        rarity = lambda w: math.log((documents + 1) / (document_counts.get(w, 0) + 1))
        self.templates = [(t.label, t.text.encode().split(), [p.encode().split() for p in t.phrases]) for t in templates]
        self.phrases = [(label, p.encode().split()) for p, label in phrases.items()]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.places: list[dict[bytes, int]] = []
        for n, (_, words, _) in enumerate(self.templates):
            bits: dict[bytes, int] = {}
            for i, w in enumerate(words):
                bits[w] = bits.get(w, 0) | 1 << i
            self.places.append(bits)
            # as many as may be missing or elsewhere, and those that must agree
            indexed = len(words) - math.ceil(LEAST_COVERED * len(words)) + self.agreeing(words)
            for i in sorted(range(len(words)), key=lambda i: (-rarity(words[i]), words[i], i))[:indexed]:
                self.postings.setdefault(words[i], []).append((n, i))
        self.starts: dict[bytes, list[tuple[int, int]]] = {}
        for n, (_, words) in enumerate(self.phrases):
            rarest = min(words, key=lambda w: (-rarity(w), w))
            self.starts.setdefault(rarest, []).append((n, words.index(rarest)))
        self.anchors = frozenset(self.postings) | frozenset(self.starts)

    @staticmethod
    def agreeing(words: list[bytes]) -> int:
        return AGREEING if len(words) >= LONG else 1

    def proposed(self, votes: list[tuple[int, int]], needed: int) -> Iterator[tuple[int, int]]:
        """Ranges of starts on which enough postings agree, from votes (start, place in the template)."""
        votes.sort()
        low = 0
        for high in range(len(votes)):
            while votes[high][0] - votes[low][0] > SHIFT:
                low += 1
            if len({place for _, place in votes[low : high + 1]}) >= needed and (high + 1 == len(votes) or votes[high + 1][0] - votes[low][0] > SHIFT):
                yield votes[low][0], votes[high][0]

    def __call__(self, text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        words = words_of(text)
        if self.anchors.isdisjoint(words):
            return len(words), 0, None, None, "", "", 0.0
        places, votes = set(), {}
        anchors = self.anchors
        for i in [i for i, w in enumerate(words) if w in anchors]:
            for n, back in self.starts.get(words[i], ()):
                if i >= back and found_in(self.phrases[n][1], words, i - back):
                    places.add((i - back, n))
            for n, back in self.postings.get(words[i], ()):
                votes.setdefault(n, []).append((i - back, back))
        base = {self.phrases[n][0] for _, n in places}
        labels, score = set(base), float(bool(base))
        for n, of_template in votes.items():
            label, parts, keys = self.templates[n]
            for first, last in self.proposed(of_template, self.agreeing(parts)):
                window = words[max(0, first - SHIFT) : max(0, last + len(parts) + SHIFT)]
                if all(any(found_in(k, window, j) for j in range(len(window))) for k in keys):
                    covered = in_order(self.places[n], len(parts), window) / len(parts)
                    if covered >= LEAST_COVERED:
                        labels.add(label)
                        score = max(score, covered)
        starts = [at for at, _ in places]
        return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def word_counts(docs: DataFrame, words: frozenset[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many documents each of the templates' words occurs, and the number of documents: as many numbers as template words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch["text"].to_pylist():
                counts.update(words.intersection(words_of(text)))
            counts[b""] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    found = docs.select(docs["text"]).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r.word): r.n for r in found}
    return counts, counts.pop(b"", 0)


def scan_licences(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs."""
    vocabulary = frozenset(w for t in [*(t.text for t in templates), *phrases] for w in t.encode().split())
    scanner = Scanner(*word_counts(docs, vocabulary), templates, phrases)
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cols = zip(*[scanner(t) for t in batch["text"].to_pylist()], strict=True)
                yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", *names])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
