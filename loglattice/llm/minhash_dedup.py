"""Near-duplicate documents by ProbMinHash over weighted five-word shingles.

A shingle's weight is how often it occurs in the document. Each shingle runs a Poisson process whose rate is its
weight; each arrival goes to a random register, which keeps the earliest. A shingle stops as soon as its next
arrival is later than every register's. Two documents agree in a register with a probability equal to their
probability Jaccard similarity. Registers are banded; of pairs that share a band, those whose registers agree often
enough are held against each other exactly.

Documents with the same words in the same order are one text here, so that groups of copies stay small. No pair is
ever a row: buckets are searched within tasks, in blocks of bounded size, first by one byte of each register. What
this connects are candidate groups; only their texts' shingles are fetched, each once, and the same search with the
exact test gives links, of which connected groups are classes: see components.links_within.

Edge cases: words are runs of letters and digits in lower case; a text of fewer than five words is one shingle;
a text without words, null or empty, is a class of its own; repeated rows fall in one class; a null doc_id is
possible and sorts last; an empty table gives an empty result; extra columns have no effect.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, giving_back, has_unique_ids, might_be_in, regrouped, text_of, with_copies, written
from .components import connected_components, links_within

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 20, 5
#: Agreeing registers, of all, under which a pair is not looked at: at the threshold, 5 standard deviations away.
LEAST_AGREEMENT = 0.6
#: Bytes of a block, about: of sketches, and of shingles, where a text counts as 4096 at least.
SKETCH_BLOCK, TEXT_BLOCK, LEAST_TEXT = 400_000, 16_000_000, 4096
#: Words that are signed at once, about.
AT_ONCE = 100_000
WORDS = re.compile(r"[^\W_]+")
REMEMBERED = 200_000
_WORD_HASHES: dict[str, int] = {}

C1, C2, C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + C1
    x = (x ^ (x >> np.uint64(30))) * C2
    x = (x ^ (x >> np.uint64(27))) * C3
    return x ^ (x >> np.uint64(31))


def word_hash(word: str) -> int:
    if len(_WORD_HASHES) >= REMEMBERED:
        _WORD_HASHES.clear()
    h = _WORD_HASHES[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
    return h


def hashes_of(text: str) -> np.ndarray:
    """The words' hashes, in order."""
    get = _WORD_HASHES.get
    return np.array([x if (x := get(w)) is not None else word_hash(w) for w in WORDS.findall(text.lower())], "u8")


def shingles_of(words: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted, and their weights."""
    if not len(words):
        return np.zeros(0, "u8"), np.zeros(0)
    n = max(1, len(words) - size + 1)
    h = np.full(n, min(len(words), size), "u8")
    for k in range(min(size, len(words))):
        h = mixed(h ^ words[k : k + n])
    found, counts = np.unique(h, return_counts=True)
    return found, counts.astype("f8")


def signatures(shingles: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """One row of register values for each weighted set: all sets' Poisson processes run at once, by arrivals."""
    doc = np.repeat(np.arange(len(shingles)), [len(s) for s, _ in shingles])
    out = np.zeros(len(shingles) * registers, "u4")
    first = np.full(len(shingles) * registers, np.inf)
    if not len(doc):
        return out.reshape(-1, registers)
    element = np.concatenate([s for s, _ in shingles])
    rate = np.concatenate([w for _, w in shingles])
    at, arrival = np.zeros(len(doc)), 0
    while len(doc):
        arrival += 1
        draw = mixed(element ^ mixed(np.full(1, arrival, "u8")))
        at = at - np.log(((draw >> np.uint64(12)).astype("f8") + 0.5) * 2.0**-52) / rate
        place = mixed(draw)
        register = doc * registers + (place % np.uint64(registers)).astype("i8")
        np.minimum.at(first, register, at)
        won = first[register] == at
        out[register[won]] = (element[won] >> np.uint64(32)).astype("u4")
        latest = first.reshape(-1, registers).max(axis=1)
        going = at < latest[doc]  # its next arrival is later still
        doc, element, rate, at = doc[going], element[going], rate[going], at[going]
    return out.reshape(-1, registers)


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard: over shared elements i, the sum of 1 / sum over j of max(x_j / x_i, y_j / y_i)."""
    common, ix, iy = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    a, b = x[1][ix], y[1][iy]
    order = np.argsort(b / a, kind="stable")
    a, b = a[order], b[order]
    ratio = b / a
    low, high = np.cumsum(a) + (x[1].sum() - a.sum()), np.cumsum(b[::-1])[::-1] + (y[1].sum() - b.sum())
    up = np.searchsorted(ratio, ratio, "right")  # elements whose ratio is not above
    above = np.append(high, y[1].sum() - b.sum())[up]
    return float((1 / (low[up - 1] / a + above / b)).sum())


def in_parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of about AT_ONCE words, and each row's word hashes."""
    start, words, size = 0, [], 0
    for i in range(batch.num_rows):
        words.append(hashes_of(batch["text"][i].as_py() or ""))
        size += len(words[-1])
        if size >= AT_ONCE or i + 1 == batch.num_rows:
            yield batch.slice(start, i + 1 - start), words
            start, words, size = i + 1, [], 0


def digest_of(words: np.ndarray) -> bytes:
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def signed(docs: DataFrame, registers: int, size: int = SHINGLE) -> DataFrame:
    """doc_id, text_key, n_words, words_digest, signature (registers, 4 bytes each), sketch (their low bytes) for each row of docs, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in in_parts(batch):
                rows = signatures([shingles_of(w, size) for w in words], registers).astype("<u4")
                columns = [part["doc_id"], part["text_key"], pa.array([len(w) for w in words], pa.int64()), pa.array([digest_of(w) for w in words], pa.binary()), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array([r.tobytes() for r in rows.astype("u1")], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n_words", "words_digest", "signature", "sketch"])

    bare = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text_of(docs)).alias("text_key"), docs["text"])
    return bare.mapInArrow(giving_back(run), "doc_id long, text_key long, n_words long, words_digest binary, signature binary, sketch binary")


def row_key(doc_id: Column | str, text_key: Column | str) -> Column:
    return F.xxhash64(doc_id, text_key)


def shingled(docs: DataFrame, wanted: DataFrame, size: int = SHINGLE) -> DataFrame:
    """key, id, signature, shingles (8 bytes each), counts (4 bytes each; empty if all are 1), n_bytes for wanted
    (key, id, doc_id, text_key, words_digest, signature), each once, by a second reading of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in in_parts(batch):
                found = [shingles_of(w, size) for w in words]
                counts = [b"" if (c == 1).all() else c.astype("<u4").tobytes() for _, c in found]
                columns = [part["rk"], part["tk"], pa.array([digest_of(w) for w in words], pa.binary()), pa.array([s.astype("<u8").tobytes() for s, _ in found], pa.binary()), pa.array(counts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["rk", "tk", "digest", "shingles", "counts"])

    mine = docs.select(row_key(docs["doc_id"].cast("long"), F.xxhash64(text_of(docs))).alias("rk"), F.xxhash64(text_of(docs)).alias("tk"), docs["text"])
    keyed = wanted.withColumn("rk", row_key("doc_id", "text_key"))
    some = mine.where(might_be_in(F.col("rk"), keyed, "rk"))
    once = some.mapInArrow(giving_back(run), "rk long, tk long, digest binary, shingles binary, counts binary").groupBy("rk", "tk").agg(F.first("digest").alias("digest"), F.first("shingles").alias("shingles"), F.first("counts").alias("counts"))
    both = keyed.join(once, (keyed["rk"] == once["rk"]) & (keyed["text_key"] == once["tk"]) & (keyed["words_digest"] == once["digest"]))
    n_bytes = F.greatest(F.lit(LEAST_TEXT), F.octet_length("signature") + F.octet_length("shingles") + F.octet_length("counts"))
    return both.select("key", "id", "signature", "shingles", "counts", n_bytes.cast("long").alias("n_bytes"))


class Sketches:
    """A block's registers by one byte each; similar are those that agree often enough. For components.links_within."""

    columns = ("sketch",)

    def __init__(self, sketches: list[bytes], least: float):
        self.rows = np.frombuffer(b"".join(sketches), "u1").reshape(len(sketches), -1)
        self.least = least * self.rows.shape[1]

    def like(self, i: int, others: np.ndarray) -> np.ndarray:
        return others[(self.rows[others] == self.rows[i]).sum(axis=1) >= self.least]


class Texts:
    """A block's signatures and shingles; similar are those that share a band, agree often enough and pass the exact test."""

    columns = ("signature", "shingles", "counts")

    def __init__(self, signatures: list[bytes], shingles: list[bytes], counts: list[bytes], bands: int, least: float, threshold: float):
        self.bands = np.frombuffer(b"".join(signatures), "<u4").reshape(len(signatures), bands, -1)
        self.least, self.threshold = least * self.bands[0].size, threshold
        self.sets = [(s := np.frombuffer(x, "<u8"), np.frombuffer(c, "<u4").astype("f8") if c else np.ones(len(s))) for x, c in zip(shingles, counts, strict=True)]
        known, place = np.unique(np.concatenate([s for s, _ in self.sets]), return_inverse=True)
        self.ends = np.cumsum([0, *(len(s) for s, _ in self.sets)])
        self.place, self.totals = place.astype("i4"), np.array([w.sum() for _, w in self.sets])
        self.share = np.concatenate([w / w.sum() for _, w in self.sets])
        self.mine = np.zeros(len(known))

    def like(self, i: int, others: np.ndarray) -> np.ndarray:
        equal = self.bands[others] == self.bands[i]
        others = others[(equal.sum(axis=(1, 2)) >= self.least) & equal.all(axis=2).any(axis=1)]
        if not len(others):
            return others
        # no similarity is above the sum over common shingles of the smaller share
        own = self.place[self.ends[i] : self.ends[i + 1]]
        self.mine[own] = self.share[self.ends[i] : self.ends[i + 1]]
        most = np.array([np.minimum(self.share[a:b], self.mine[self.place[a:b]]).sum() for a, b in zip(self.ends[others], self.ends[others + 1], strict=True)])
        self.mine[own] = 0
        others = others[most >= self.threshold - 1e-9]
        return others[np.array([similarity(self.sets[i], self.sets[j]) >= self.threshold for j in others], bool)]


def classes_of(docs: DataFrame, texts: DataFrame, threshold: float, bands: int, rows: int, size: int, least: float, sketch_block: int = SKETCH_BLOCK, text_block: int = TEXT_BLOCK) -> DataFrame:
    """node, component for the texts (node, doc_id, text_key, words_digest, signature, sketch) that are similar to another one."""
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("signature"), i * (4 * rows) + 1, F.lit(4 * rows)))))
    buckets = texts.select(band.alias("key"), F.col("node").alias("id"))
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    sketches = texts.select(F.col("node").alias("id"), "sketch", F.octet_length("sketch").cast("long").alias("n_bytes"))
    members = buckets.join(regrouped(shared, "key"), "key").join(sketches, "id").select("key", "id", "sketch", "n_bytes")
    members = written(members, "buckets", codec="lz4")
    candidates, _ = links_within(members, Sketches, sketch_block, least)
    groups = written(connected_components(candidates).select(F.col("component").alias("key"), F.col("node").alias("id")), "candidate-groups")
    wanted = groups.join(texts.select(F.col("node").alias("id"), "doc_id", "text_key", "words_digest", "signature"), "id")
    held = written(shingled(docs, written(wanted, "candidate-texts"), size), "shingles", codec="lz4")
    links, settled = links_within(held, Texts, text_block, bands, least, threshold)
    for used in (members, held):
        discard(used)
    if settled:  # each group was searched as one, so that links are stars around the smallest
        return links.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    return connected_components(links)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE, least: float = LEAST_AGREEMENT, signs: DataFrame | None = None) -> DataFrame:
    """doc_id, text_key, n_words, class_id, class_size, kept: one row for each row of docs.

    class_id is the smallest doc_id of the class; the row of that document is the one kept.
    """
    signs = written(signed(docs, bands * rows, size), "signatures", row_id="row_id") if signs is None else signs
    with_words = signs.where("n_words > 0")
    first = F.min_by(F.struct("doc_id", "text_key", "signature", "sketch"), "row_id")
    texts = written(with_words.groupBy("words_digest").agg(F.min("row_id").alias("node"), first.alias("f")).select("words_digest", "node", "f.*"), "texts")
    groups = classes_of(docs, texts, threshold, bands, rows, size, least)
    of_text = texts.join(groups, "node", "left").select("words_digest", F.coalesce("component", "node").alias("component"))
    alone = signs.where("n_words = 0").select("row_id", "doc_id", "text_key", "n_words", F.col("row_id").alias("component"))
    rows_in = signs.where("n_words > 0").join(of_text, "words_digest").select("row_id", "doc_id", "text_key", "n_words", "component").unionByName(alone)
    rows_in = written(rows_in, "classed")
    discard(texts)
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("row_id").alias("c"))
    classes = rows_in.groupBy("component").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("class_size"))
    return rows_in.join(regrouped(classes, "component"), "component").select("doc_id", "text_key", "n_words", F.col("best.b").alias("class_id"), "class_size", (F.col("row_id") == F.col("best.c")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each class."""
    signs = written(signed(docs, BANDS * ROWS), "signatures", row_id="row_id")
    found = near_duplicates(docs, threshold, signs=signs)
    return with_copies(docs, found.select("doc_id", "text_key", F.col("kept").cast("int").alias("copies")), has_unique_ids(signs))
