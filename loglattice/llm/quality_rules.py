"""Quality rules and isolation forests on their statistics.

One pass takes the statistics of every whole text. For each group of statistics an isolation forest is grown on a
bounded sample of the documents that pass the base rules: each tree splits SAMPLE rows at random until they are alone,
so that odd documents end on short paths. Every document gets, for each group, the score 2 ** (-mean path length / that
of a random tree). From the scores of all labelled rows, by a histogram, comes a threshold for each group: it parts the
two qualities best, among those that reject MOST_REJECTED of the good rows at most and more bad rows than good; each
group is held against the rows that those before it leave, and rejects nothing where no score parts them. A document goes if a score reaches its threshold. The statistics are shares, held near none in short
texts, so that neither long nor short documents are odd as such, and no language's letters count.

Edge cases: a null or empty text has no words, so the base rules reject it; texts of any length are taken whole; rows
with equal ids, null ids too, are judged each by its own text; several labels of one id count as the worst, null ones
not at all; without labelled rows of both qualities the thresholds are DEFAULT; an empty table gives an empty result;
extra columns have no effect.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, uniform, written

#: Rows that the forest is grown on, about; trees; rows of a tree.
POOL, TREES, SAMPLE = 25_600, 100, 256
#: Of labelled good rows, the share that the threshold may reject; the threshold without labels; bins of the histogram.
MOST_REJECTED, DEFAULT, BINS = 0.002, 0.75, 10_000
# The base rules of the contract.
SYMBOLS, LEAST_WORDS, MOST_REPEATED, WINDOW = "#*$%&|<>", 50, 50, 3

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Groups of statistics, each with a forest and a threshold of its own.
GROUPS = {"symbols": ("symbol_share",), "marks": ("mark_share", "odd_word_share"), "case": ("upper_share",), "digits": ("digit_share",), "repeats": ("dup_line_share", "repeat_share", "common_share")}
SHARES = tuple(c for group in GROUPS.values() for c in group)
#: Words, lines and characters that a text counts more than it has when shares are taken.
MORE_WORDS, MORE_LINES, MORE_CHARS = 50, 5, 250
#: Kinds of characters, by code point; those beyond the table count as its last one, a mark.
MARK, LETTER, UPPER, DIGIT, BLANK = range(5)
KIND = np.array([BLANK if c in " \t\n\r\x0b\f" else UPPER if c.isupper() else LETTER if c.isalpha() else DIGIT if c.isdigit() else MARK for c in map(chr, range(0x10000))], dtype=np.uint8)


def repeated_words(codes: np.ndarray) -> int:
    """How many words lie in a window of three words that is found twice or more. codes: a number for each word."""
    if len(codes) <= WINDOW:
        return 0
    windows = np.lib.stride_tricks.sliding_window_view(codes, WINDOW)
    top = int(codes.max()) + 1
    if top ** WINDOW < 2**63:
        flat = windows[:, 0]
        for i in range(1, WINDOW):
            flat = flat * top + windows[:, i]
        _, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    else:
        _, at, n = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    twice = np.zeros(len(codes), dtype=bool)
    starts = np.flatnonzero(n[at.reshape(-1)] > 1)
    for i in range(WINDOW):
        twice[starts + i] = True
    return int(twice.sum())


def statistics_of(text: str | None) -> tuple:
    """COUNTS, then SHARES, of one text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # white space of bytes is that of the contract
    if not words:
        return (0, 0, sum(map(text.count, SYMBOLS)), 0, 0, *[0.0] * len(SHARES))
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\f")]
    n, n_dup_lines, n_repeat = len(words), len(lines) - len(set(lines)), repeated_words(codes)
    kinds = np.bincount(KIND[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), len(KIND) - 1)], minlength=5).tolist()
    bare, letters, symbols = len(text) - kinds[BLANK], kinds[LETTER] + kinds[UPPER], sum(map(text.count, SYMBOLS))
    odd = sum(1 for w in words if not (w[0] >= 128 or w[:1].isalnum()))
    most = int(np.bincount(codes).max())
    of_words, of_chars = n + MORE_WORDS, bare + MORE_CHARS
    shares = (symbols / of_words, kinds[MARK] / of_chars, odd / of_words, kinds[UPPER] / (letters + MORE_CHARS), kinds[DIGIT] / of_chars, n_dup_lines / (len(lines) + MORE_LINES), n_repeat / of_words, most / of_words)
    return (n, bare, symbols, n_dup_lines, n_repeat, *shares)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS, SHARES and base_failed of each row of docs."""
    names, types = [*COUNTS, *SHARES], [*[pa.int64()] * len(COUNTS), *[pa.float64()] * len(SHARES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cols = zip(*[statistics_of(t.as_py()) for t in batch["text"]], strict=True)
                yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", *names])

    schema = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), *(f"{c} double" for c in SHARES)])
    made = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, schema)
    return made.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def usual_path(n: int) -> float:
    """The mean path length of an unsuccessful search in a random binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


@dataclass
class Forest:
    """For each tree and node: the statistic to split by and where, the nodes below, and at a leaf its path length."""

    by: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    path: np.ndarray
    depth: int
    usual: float

    @classmethod
    def grow(cls, rows: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 7) -> Forest:
        rng, grown = np.random.default_rng(seed), []
        sample = min(sample, len(rows))
        depth = max(1, math.ceil(math.log2(max(2, sample))))
        for _ in range(trees):
            nodes: list[list] = []
            todo = [(rows[rng.choice(len(rows), sample, replace=False)], 0, -1, 0)] if len(rows) else [(rows, 0, -1, 0)]
            while todo:
                mine, level, parent, side = todo.pop()
                if parent >= 0:
                    nodes[parent][2 + side] = len(nodes)
                low, high = (mine.min(0), mine.max(0)) if len(mine) else (np.zeros(rows.shape[1]),) * 2
                wide = np.flatnonzero(high > low)
                if level == depth or not len(wide):
                    nodes.append([0, 0.0, len(nodes), len(nodes), level + usual_path(len(mine))])
                    continue
                by = int(rng.choice(wide))
                cut = float(rng.uniform(low[by], high[by]))
                cut = cut if cut > low[by] else float(high[by])
                nodes.append([by, cut, -1, -1, 0.0])
                left = mine[:, by] < cut
                todo += [(mine[left], level + 1, len(nodes) - 1, 0), (mine[~left], level + 1, len(nodes) - 1, 1)]
            grown.append(nodes)
        size = max(map(len, grown))
        table = np.zeros((trees, size, 5))
        for t, nodes in enumerate(grown):
            table[t, : len(nodes)] = nodes
        return cls(table[..., 0].astype(np.int32), table[..., 1], table[..., 2:4].astype(np.int32), table[..., 4], depth, usual_path(sample) or 1.0)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for by, cut, below, path in zip(self.by, self.cut, self.below, self.path, strict=True):
            at = np.zeros(len(rows), dtype=np.int32)
            for _ in range(self.depth):
                at = below[at, (rows[every, by[at]] >= cut[at]).astype(np.int8)]
            total += path[at]
        return 2.0 ** (-total / len(self.by) / self.usual)


def grown_on(stats: DataFrame, pool: int = POOL, seed: int = 7) -> dict[str, Forest]:
    """A forest for each group, grown on about `pool` of the rows that pass the base rules, drawn by hash."""
    good = stats.where(~F.col("base_failed"))
    share = pool / max(pool, good.count())
    drawn = good.where(uniform("doc_id", "n_words", "word_chars", F.lit(seed)) < share).select(*SHARES).collect()
    rows = np.array(sorted(map(tuple, drawn)), dtype=float).reshape(-1, len(SHARES))
    return {name: Forest.grow(rows[:, [SHARES.index(c) for c in group]], seed=seed + i) for i, (name, group) in enumerate(GROUPS.items())}


def scored(stats: DataFrame, forests: dict[str, Forest]) -> DataFrame:
    """stats with a score from 0 to 1 for each group, named by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [f.scores(np.column_stack([batch[c].to_numpy(zero_copy_only=False) for c in GROUPS[name]])) for name, f in forests.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, made)], names=[*batch.schema.names, *forests])

    return stats.mapInArrow(run, ", ".join([*(f"{n} {t}" for n, t in stats.dtypes), *(f"{name} double" for name in forests)]))


def threshold_from(counts: list[tuple[int, int, int]], most_rejected: float = MOST_REJECTED) -> float:
    """The score that parts good from bad best, and rejects more bad rows than good; over 1 if none does.

    counts: (bin of the score, quality 0 or 1, rows).
    """
    bad, good = Counter(), Counter()
    for at, quality, n in counts:
        (good if quality else bad)[at] += n
    best, cut = 0.0, 2.0
    rejected_bad = rejected_good = 0
    bins = sorted(bad.keys() | good.keys(), reverse=True)
    for at, lower in zip(bins, [*bins[1:], -1], strict=False):
        rejected_bad, rejected_good = rejected_bad + bad[at], rejected_good + good[at]
        if rejected_good > most_rejected * good.total():
            break
        gain = rejected_bad / max(1, bad.total()) - rejected_good / max(1, good.total())
        if gain > best and rejected_bad > rejected_good:
            best, cut = gain, (at + lower + 1) / 2 / BINS if lower >= 0 else at / BINS
    return cut


def calibrated(scores: DataFrame, labels: DataFrame) -> dict[str, float]:
    """Thresholds from all labelled rows that pass the base rules, group by group: each from the rows that the groups
    before leave. The driver gets two numbers for each bin at most."""
    known = labels.where(labels["quality"].isNotNull()).groupBy(labels["doc_id"].alias("id")).agg((F.min("quality") > 0).cast("int").alias("good"))
    of = scores.where(~F.col("base_failed")).select("doc_id", *GROUPS)
    left = labelled = written(of.join(known, of["doc_id"] == known["id"]).select("good", *GROUPS), "quality-labelled")
    found: dict[str, float] = {}
    if labelled.select("good").distinct().count() < 2:
        return dict.fromkeys(GROUPS, DEFAULT)
    for name in GROUPS:
        found[name] = threshold_from([tuple(r) for r in left.groupBy(F.floor(F.col(name) * BINS).cast("int"), "good").agg(F.count(F.lit(1)).alias("n")).collect()])
        left = left.where(F.col(name) < found[name])
    discard(labelled)
    return found


def judge_quality(docs: DataFrame, labels: DataFrame, pool: int = POOL, seed: int = 7) -> DataFrame:
    """doc_id, COUNTS, SHARES, base_failed, a score for each group, kept and odd, the groups that reject, for each row of docs.

    labels: doc_id, quality (0 or 1).
    """
    stats = written(statistics(docs), "quality-statistics")
    scores = written(scored(stats, grown_on(stats, pool, seed)), "quality-scores")
    thresholds = calibrated(scores, labels)
    discard(stats)
    odd = F.array_compact(F.array(*[F.when(F.col(name) >= t, F.lit(name)) for name, t in thresholds.items()]))
    return scores.withColumn("odd", odd).withColumn("kept", ~F.col("base_failed") & (F.size("odd") == 0))
