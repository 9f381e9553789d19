"""Language identification by word-first backoff.

A word that the model knows scores its log frequency in each language; another one falls back to its longest
character n-grams that are known, then to shorter ones. The counts come from a bounded sample of labelled
documents (PER_LANGUAGE of each language, chosen by hash), so that the model has a bounded size; predictions read
every whole text in one pass without a shuffle.

Edge cases: a null text, or one without a letter, is `und` with score 0; a language label of null is not learned
from; with nothing to learn from, every document is `und`; ties go to the language first by code point; an empty
table gives an empty result; rows are judged one by one, so repeated rows agree; extra columns have no effect.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import giving_back, packed_rows, remainder, written

#: Labelled documents of each language that the model learns from, about; words and n-grams that it keeps.
PER_LANGUAGE, MOST_WORDS, MOST_GRAMS = 1500, 60_000, 120_000
LONGEST = 5
UNDETERMINED = "und"
#: A language is in doubt where its score is not above this many times what it would be by chance.
DOUBT = 1.2
LETTERS = re.compile(r"[^\W\d_]+")
#: Rows that a worker remembers, by token.
REMEMBERED = 300_000


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case. The expression takes numbers like Roman numerals for letters, which they are not."""
    found = LETTERS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return ["".join(run) for word in found for letters, run in groupby(word, str.isalpha) if letters]


def grams_of(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (lang, length of the n-gram or 0 for a word, gram) within a task."""
    words: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(words_of(text))
    for lang, counts in words.items():
        for n in range(LONGEST + 1):
            grams: Counter = Counter()
            for word, c in counts.items():
                for g in [word] if n == 0 else grams_of(word, n):
                    grams[g] += c
            items = list(grams.items())
            for i in range(0, len(items), 50_000):
                part = items[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([n] * len(part), pa.int32()), pa.array([g for g, _ in part]), pa.array([c for _, c in part], pa.int64())], names=["lang", "n", "gram", "c"])


class Model:
    """Log frequencies by language, one row for each word and n-gram."""

    def __init__(self, counts: list[tuple[str, int, str, int]]):
        self.langs = sorted({lang for lang, *_ in counts})
        place = {lang: i for i, lang in enumerate(self.langs)}
        self.tables: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        rows = np.zeros((len(counts), len(self.langs)))
        level, totals = np.zeros(len(counts), int), np.zeros((LONGEST + 1, len(self.langs)))
        size = 0
        for lang, n, gram, c in counts:
            at = self.tables[n].setdefault(gram, size)
            if at == size:
                level[at], size = n, size + 1
            rows[at, place[lang]] += c
            totals[n, place[lang]] += c
        kinds = np.array([len(t) + 1 for t in self.tables])
        self.rows = np.log((rows[:size] + 0.1) / (totals + 0.1 * kinds[:, None])[level[:size]]).astype("f4")

    def places(self, word: str) -> list[int]:
        """The rows that speak for a word: its own, or those of its longest n-grams that are known."""
        known = self.tables[0].get(word)
        if known is not None:
            return [known]
        marked = f"^{word}$"
        for n in range(LONGEST, 0, -1):
            table = self.tables[n]
            found = [x for i in range(len(marked) - n + 1) if (x := table.get(marked[i : i + n])) is not None]
            if found:
                return found
        return []


class Judge:
    """Scores whole texts; remembers the row of each token it has met, up to a bound."""

    def __init__(self, model: Model):
        self.model, self.width = model, len(model.langs)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.matrix = np.zeros((0, self.width + 1), "f4")

    def meet(self, tokens: list[str]) -> None:
        """Adds the rows of new tokens: sums over a token's words, each the mean of the rows that speak for it."""
        at, weight, of, letters = [], [], [], np.zeros(len(tokens), "f4")
        for i, token in enumerate(tokens):
            for word in words_of(token):
                letters[i] = 1
                if found := self.model.places(word):
                    at += found
                    weight += [1 / len(found)] * len(found)
                    of += [i] * len(found)
        rows = np.zeros((len(tokens), self.width + 1), "f4")
        if at:
            each = self.model.rows[at] * np.array(weight, "f4")[:, None]
            for lang in range(self.width):
                rows[:, lang] = np.bincount(of, weights=each[:, lang], minlength=len(tokens))
        rows[:, -1] = letters
        start = len(self.known)
        self.known.update(zip(tokens, range(start, start + len(tokens)), strict=True))
        self.matrix = np.concatenate([self.matrix, rows])

    def judge(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out, group, size = [], [], 0
        for text in texts:
            tokens = (text or "").split()
            group.append(tokens)
            size += len(tokens)
            if size > 200_000:
                out += self.scored(group)
                group, size = [], 0
        return out + self.scored(group)

    def scored(self, group: list[list[str]]) -> list[tuple[str, float]]:
        if not self.width:
            return [(UNDETERMINED, 0.0)] * len(group)
        if len(self.known) > REMEMBERED:
            self.forget()
        known = self.known
        new = list(dict.fromkeys(t for tokens in group for t in tokens if t not in known))
        if new:
            self.meet(new)
        out = []
        for tokens in group:
            total = self.matrix[np.fromiter(map(known.__getitem__, tokens), "i8", len(tokens))].sum(axis=0, dtype="f8")
            if not total[-1]:
                out.append((UNDETERMINED, 0.0))
                continue
            scores = total[:-1]
            best = int(np.argmax(scores))
            out.append((self.model.langs[best], float(1 / np.exp(scores - scores[best]).sum())))
        return out


def fit(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE, seed: int = 11) -> Model:
    """Learns from documents where learn holds and lang is known: about per_language of each language, by hash."""
    labelled = docs.where(learn & docs["lang"].isNotNull() & docs["text"].isNotNull())
    # one number for each language, as the model has one column for each: no text is shuffled to draw the sample
    shares = {r.lang: per_language / r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.try_element_at(F.create_map(*[F.lit(x) for kv in shares.items() for x in kv]), F.col("lang")) if shares else F.lit(0.0)
    draw = F.xxhash64("doc_id", F.lit(seed)).bitwiseAND(F.lit((1 << 31) - 1)) / float(1 << 31)
    sample = labelled.where(draw < share)
    counts = written(sample.select("lang", "text").mapInArrow(giving_back(_counted), "lang string, n int, gram string, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c")), "language-counts")
    # bounded: each language's most frequent words and n-grams, as many for each, with their counts in all languages
    most = F.when(F.col("n") == 0, MOST_WORDS // max(1, len(shares))).otherwise(MOST_GRAMS // LONGEST // max(1, len(shares)))
    place = F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("c"), "gram"))
    kept = counts.withColumn("place", place).where(F.col("place") <= most).select("n", "gram").distinct()
    return Model(sorted(tuple(r) for r in counts.join(kept, ["n", "gram"]).select("lang", "n", "gram", "c").collect()))


def judged(docs: DataFrame, model: Model, keep: Callable[[str, float], bool] | None = None) -> DataFrame:
    """docs (doc_id, text, ...) with lang_pred and score; with keep, docs' own columns of those that it accepts."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for batch in batches:
            found = judge.judge(batch["text"].to_pylist())
            if keep:
                yield batch.filter(pa.array([keep(*x) for x in found], pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*names, "lang_pred", "score"])

    schema = docs.schema if keep else StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(giving_back(run), schema)


def identify_languages(docs: DataFrame, folds: int = 4, held_out: int = 2, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; learned from the rows that are not held out."""
    out = remainder(docs, folds) == held_out
    model = fit(docs, ~out, per_language)
    return judged(docs.select("doc_id", out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def drop_unidentified(docs: DataFrame, doubt: float = DOUBT, folds: int = 4, held_out: int = 2) -> DataFrame:
    """docs without those whose language is undetermined or in doubt; with one language to learn, none is in doubt."""
    model = fit(docs, remainder(docs, folds) != held_out)
    least = min(1.0, doubt / max(1, len(model.langs)))
    one = docs.select(packed_rows(docs), docs["text"])
    return judged(one, model, keep=lambda lang, score: lang != UNDETERMINED and score >= least).select("row.*")
