"""Language-model scores by Katz backoff over word bigrams.

Counts are discounted by Good-Turing up to K; what a context's seen successors leave is shared among the others in
proportion to their unigram probability, with backoff weights that make every context sum to one over the training
vocabulary and one unknown word. Higher counts keep their share, but for one imaginary token of the context.

All tokens count. Texts are tokenised once into chunks of about CHUNK tokens; a chunk knows its distinct words and,
later, its distinct pairs, and only those travel: words to their counts and back, pairs as packed arrays to the
partition of their context and back. Contexts with HOT tokens are spread over all partitions by pair. The n-gram
tables lie in the shared folder by partition. Each token is then evaluated by recursion: pair, else backoff weight
times word, else unknown.

Edge cases: a null text counts as empty and has the end token alone; a document of any length stays in one chunk;
a null doc_id counts as empty text for the split; with no training documents every count is 0, base scores are
those of one unknown type, and the model gives the unknown word probability 1; repeated rows count and are scored
each; an empty table gives an empty result; extra columns have no effect.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, regrouped, remainder, written

#: Counts up to K are discounted; tokens of a chunk; pairs of a partition, about; tokens from which a context is spread.
K, CHUNK, PAIRS, HOT = 5, 1_000_000, 1_500_000, 400_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The end token is no word; the start is a context only.
END, START = b" ", -1
#: Chunks that a word is in from which its count is summed apart, so that no task has all of its rows.
SHARED = 10_000
#: Chunks that a task may have, of a million tokens each; a word's number is its chunk's, then PLACES for its place there.
TASK_CHUNKS, PLACES = 1 << 13, 1 << 30
LAST_CHUNK = (1 << 63) // PLACES


def tokens_of(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").translate(LOWER).split(), END]


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """One row at a time: rows here are large."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def packed(numbers: np.ndarray) -> bytes:
    """Bytes of like weight together, compressed."""
    a = np.ascontiguousarray(numbers)
    return zstandard.ZstdCompressor(level=1).compress(a.view("u1").reshape(len(a), a.itemsize).T.tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "u1")
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def discounts(of_counts: np.ndarray) -> np.ndarray:
    """d[r] for r up to K, from the numbers of n-grams that occur 1 to K + 1 times; d[0] is not used.

    Katz's form of Good-Turing, with the largest k that gives all of them between 0 and 1; a constant share off
    each count where none does.
    """
    n = np.append(0.0, np.asarray(of_counts, "f8"))
    d = np.ones(K + 1)
    for k in range(K, 0, -1):
        if n[1 : k + 2].all():
            tail = (k + 1) * n[k + 1] / n[1]
            r = np.arange(1, k + 1)
            got = ((r + 1) * n[2 : k + 2] / (r * n[1 : k + 1]) - tail) / (1 - tail) if tail != 1 else np.zeros(k)
            if ((got > 0) & (got < 1)).all():
                d[1 : k + 1] = got
                d[k + 1 :] = 1 - 1e-9
                return d
    off = min(0.9, max(0.1, n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5))
    d[1:] = 1 - off / np.arange(1, K + 1)
    return d


def share(count: np.ndarray, total: np.ndarray | float, d: np.ndarray) -> np.ndarray:
    """The discounted probability of what occurs count of total times; 0 for 0."""
    low = d[np.minimum(count, K)] * count / np.maximum(total, 1)
    return np.where(count > K, count / (total + 1.0), low)


@dataclass(frozen=True)
class Unigrams:
    tokens: int
    types: int
    documents: int
    d: np.ndarray
    unknown: float

    def p(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, share(count, self.tokens, self.d), self.unknown)


def chunked(docs: DataFrame, held_out: int, folds: int, chunk: int) -> DataFrame:
    """chunk, doc_ids, held, lengths, tokens (packed places in words), words, counts (in training), one row for each chunk."""
    schema = "chunk long, doc_ids array<long>, held array<boolean>, lengths array<int>, tokens binary, words array<binary>, counts array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() * TASK_CHUNKS  # the same again if the task is repeated
        number = first
        ids, held, lengths, places, known = [], [], [], [], {END: 0}

        def flush() -> pa.RecordBatch:
            if number >= min(first + TASK_CHUNKS, LAST_CHUNK):
                raise ValueError(f"over {TASK_CHUNKS} chunks in a task, or over {LAST_CHUNK // TASK_CHUNKS} tasks: raise the tokens of a chunk, or the bytes of a task")
            at = np.concatenate(places)
            trained = np.repeat(~np.array(held), lengths)
            counts = np.bincount(at[trained], minlength=len(known))
            cols = [[number], [ids], [held], [lengths], [packed(at)], [list(known)], [counts]]
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["chunk", "doc_ids", "held", "lengths", "tokens", "words", "counts"])

        size = 0
        for batch in batches:
            for doc_id, out, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "held", "text")), strict=True):
                words = tokens_of(text)
                places.append(np.fromiter((known.setdefault(w, len(known)) for w in words), "i4", len(words)))
                ids.append(doc_id)
                held.append(out)
                lengths.append(len(words))
                size += len(words)
                if size >= chunk:
                    yield flush()
                    number += 1
                    ids, held, lengths, places, known, size = [], [], [], [], {END: 0}, 0
        if ids:
            yield flush()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (remainder(docs, folds) == held_out).alias("held"), docs["text"])
    return rows.mapInArrow(run, schema)


def with_counts(chunks: DataFrame, shared: int = SHARED) -> DataFrame:
    """Chunks whose words have become numbers: w_id (its first chunk and place there) and c (its count in training); and
    of the words that are at home in the chunk, how many occur 1 to K + 1 times, and at all."""
    words = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x")).select("chunk", "at", "x.words", "x.counts")
    mine = F.col("chunk") * PLACES + F.col("at")
    # a frequent word is in every chunk: it is summed in parts, and its rows are dealt out by chunk
    totals = words.groupBy("words").agg(F.sum("counts").alias("all_c"), F.min(mine).alias("all_id"), F.count(F.lit(1)).alias("n"))
    frequent = written(totals.where(F.col("n") >= shared).drop("n"), "frequent-words")
    dealt = regrouped(words.join(frequent, "words", "left"), "words").withColumn("deal", F.when(F.col("all_c").isNotNull(), F.col("chunk")))
    every = Window.partitionBy("words", "deal")
    counted = dealt.withColumn("c", F.coalesce("all_c", F.sum("counts").over(every))).withColumn("w_id", F.coalesce("all_id", F.min(mine).over(every)))
    by_chunk = counted.groupBy(F.col("chunk").alias("of")).agg(F.collect_list(F.struct("at", "c", "w_id")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                known = batch["known"][i].values
                order = np.argsort(known.field("at").to_numpy())
                c, w_id = known.field("c").to_numpy()[order], known.field("w_id").to_numpy()[order]
                home = c[w_id == batch["chunk"][i].as_py() * PLACES + np.arange(len(c))]
                of_counts = np.bincount(np.minimum(home, K + 2), minlength=K + 3)
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([one["chunk"], one["doc_ids"], one["held"], one["lengths"], one["tokens"], pa.array([packed(c)], pa.binary()), pa.array([packed(w_id)], pa.binary()), pa.array([int((home > 0).sum())], pa.int64()), pa.array([of_counts[1 : K + 2].tolist()], pa.list_(pa.int64()))], names=["chunk", "doc_ids", "held", "lengths", "tokens", "c", "w_id", "types", "of_counts"])

    both = chunks.drop("words", "counts").join(by_chunk, F.col("chunk") == F.col("of"))
    return both.select("chunk", "doc_ids", "held", "lengths", "tokens", "known").mapInArrow(run, "chunk long, doc_ids array<long>, held array<boolean>, lengths array<int>, tokens binary, c binary, w_id binary, types long, of_counts array<long>")


def summed(of_counts: DataFrame, name: str) -> np.ndarray:
    """Element-wise sums of arrays of K + 1 numbers."""
    row = of_counts.agg(*[F.coalesce(F.sum(F.get(name, F.lit(r))), F.lit(0)) for r in range(K + 1)]).first()
    return np.array(row, "f8")


class Pairs:
    """The distinct pairs of a chunk, in an order that both ways share: by partition, context, word."""

    def __init__(self, row: dict, documents: int, partitions: int, hot: int):
        self.lengths = np.array(row["lengths"], "i8")
        self.c, self.w_id = unpacked(row["c"], "i8"), unpacked(row["w_id"], "i8")
        at = unpacked(row["tokens"], "i4").astype("i8")
        self.at, n = at, len(self.c)
        before = np.empty_like(at)
        before[1:] = at[:-1]
        self.starts = np.append(0, np.cumsum(self.lengths)[:-1])
        before[self.starts] = n
        keys, self.inverse = np.unique(before * (n + 1) + at, return_inverse=True)
        lv, self.lw = keys // (n + 1), keys % (n + 1)
        self.v = np.append(self.w_id, START)[lv]
        self.cv = np.append(self.c, documents)[lv]
        self.w, self.cw = self.w_id[self.lw], self.c[self.lw]
        trained = np.repeat(~np.array(row["held"]), self.lengths)
        self.n = np.bincount(self.inverse, weights=trained, minlength=len(keys)).astype("i8")
        h = _mixed(self.v) ^ np.where(self.cv >= hot, _mixed(self.w + 1), np.uint64(0))
        self.p = (_mixed(h.view("i8")) % np.uint64(partitions)).astype("i8")
        self.order = np.lexsort((self.w, self.v, self.p))
        self.ends = np.searchsorted(self.p[self.order], np.arange(partitions + 1))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype("i8").view("u8") * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def sent_pairs(chunks: DataFrame, documents: int, partitions: int, hot: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                x = Pairs(row, documents, partitions, hot)
                out = []
                for p in np.unique(x.p):
                    at = x.order[x.ends[p] : x.ends[p + 1]]
                    out.append((int(p), row["chunk"], packed(np.diff(x.v[at], prepend=0)), packed(x.w[at]), packed(x.n[at].astype("u4")), packed(x.cv[at]), packed(x.cw[at])))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[2:])], names=["p", "chunk", "v", "w", "n", "cv", "cw"])

    return chunks.select("chunk", "held", "lengths", "tokens", "c", "w_id").mapInArrow(run, "p long, chunk long, v binary, w binary, n binary, cv binary, cw binary")


#: kind `table`: an n-gram table (v, w, n: its counts). `reply`: a chunk's counts (n), in its order. `contexts`: each
#: context's cv, numbers of successors by count (n, K for each), tokens of higher ones (w), their words' probability (q);
#: and the pairs not seen in training: their chunks (c1) and places among the contexts (c2).
MODEL = "kind string, p long, chunk long, v binary, w binary, n binary, cv binary, q binary, c1 binary, c2 binary, of_counts array<long>"


def counted_pairs(sent: DataFrame, unigrams: Unigrams) -> DataFrame:
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(name, types[kind]) for name, kind in (x.split() for x in MODEL.split(", "))])

    def run(group: pa.Table) -> pa.Table:
        rows = {c: x.to_pylist() for c, x in zip(group.column_names, group.sort_by("chunk").columns, strict=True)}
        v = [np.cumsum(unpacked(x, "i8")) for x in rows["v"]]
        sizes = np.array([len(x) for x in v])
        v = np.concatenate(v)
        w, cv, cw = (np.concatenate([unpacked(x, "i8") for x in rows[c]]) for c in ("w", "cv", "cw"))
        n = np.concatenate([unpacked(x, "u4") for x in rows["n"]]).astype("i8")
        order = np.lexsort((w, v))
        sv, sw = v[order], w[order]
        new = np.append(True, (sv[1:] != sv[:-1]) | (sw[1:] != sw[:-1]))
        first = np.flatnonzero(new)
        total = np.add.reduceat(n[order], first)
        of_entry = np.empty(len(v), "i8")
        of_entry[order] = total[np.cumsum(new) - 1]
        pv, pw, pcv = sv[first], sw[first], cv[order][first]
        seen = total > 0
        word = np.where(seen, unigrams.p(cw[order][first]), 0.0)
        starts = np.flatnonzero(np.append(True, pv[1:] != pv[:-1]))
        few = np.stack([np.add.reduceat((total == r).astype("i8"), starts) for r in range(1, K + 1)], axis=1)
        many = np.add.reduceat(np.where(total > K, total, 0), starts)
        contexts, of_context = pv[starts], pcv[starts]
        unseen = np.flatnonzero((of_entry == 0) & (cv > 0))
        chunk_of = np.repeat(np.array(rows["chunk"]), sizes)
        p = rows["p"][0]
        out = [dict(kind="reply", p=p, chunk=c, n=packed(x.astype("u4"))) for c, x in zip(rows["chunk"], np.split(of_entry, np.cumsum(sizes)[:-1]), strict=True)]
        out.append(dict(kind="table", p=p, v=packed(np.diff(pv[seen], prepend=0)), w=packed(pw[seen]), n=packed(total[seen].astype("u4"))) if seen.any() else dict(kind="table", p=p))
        out.append(dict(kind="contexts", p=p, v=packed(contexts), cv=packed(of_context), n=packed(few.ravel()), w=packed(many), q=packed(np.add.reduceat(word, starts)), c1=packed(chunk_of[unseen]) if len(unseen) else None, c2=packed(np.searchsorted(contexts, v[unseen])) if len(unseen) else None, of_counts=np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1 : K + 2].tolist()))
        return pa.Table.from_pylist(out, schema)

    return sent.groupBy("p").applyInArrow(run, MODEL)


def backoff(cv: np.ndarray, few: np.ndarray, many: np.ndarray, q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """What a context leaves, over what its unseen words have by themselves."""
    taken = (few * (d[1:] * np.arange(1, K + 1))).sum(axis=1) / np.maximum(cv, 1) + many / (cv + 1.0)
    return (1 - taken) / (1 - q)


def backoff_replies(contexts: DataFrame, d: np.ndarray, hot: int) -> DataFrame:
    """chunk, p, alpha: backoff weights of the pairs not seen in training, in the chunk's order."""

    def read(row: dict) -> tuple[np.ndarray, ...]:
        return unpacked(row["v"], "i8"), unpacked(row["cv"], "i8"), unpacked(row["n"], "i8").reshape(-1, K), unpacked(row["w"], "i8"), unpacked(row["q"], "f8")

    def hot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                v, cv, few, many, q = read(row)
                at = np.flatnonzero(cv >= hot)
                yield pa.RecordBatch.from_arrays([pa.array([row["p"]] * len(at), pa.int64()), pa.array(v[at]), pa.array(cv[at]), *(pa.array(few[at, r]) for r in range(K)), pa.array(many[at]), pa.array(q[at])], names=["p", "v", "cv", *(f"r{r}" for r in range(K)), "many", "q"])

    spread = contexts.select("p", "v", "cv", "n", "w", "q").mapInArrow(hot_rows, "p long, v long, cv long, " + "".join(f"r{r} long, " for r in range(K)) + "many long, q double")
    spread = written(spread, "hot-contexts")
    whole = spread.groupBy("v").agg(F.first("cv").alias("cv"), *[F.sum(f"r{r}").alias(f"r{r}") for r in range(K)], F.sum("many").alias("many"), F.sum("q").alias("q"))
    taken = sum((F.col(f"r{r}") * float(d[r + 1] * (r + 1)) for r in range(K)), F.lit(0.0)) / F.col("cv") + F.col("many") / (F.col("cv") + 1.0)
    alpha = whole.select("v", ((1 - taken) / (1 - F.col("q"))).alias("alpha"))
    of_p = spread.select("p", "v").join(alpha, "v").groupBy(F.col("p").alias("hot_p")).agg(F.collect_list(F.struct("v", "alpha")).alias("hot"))

    def replies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                v, *numbers = read(row)
                a = backoff(*numbers, d)
                for x in row["hot"] or ():
                    a[np.searchsorted(v, x["v"])] = x["alpha"]
                chunk, at = unpacked(row["c1"], "i8"), unpacked(row["c2"], "i8")
                ids, starts = np.unique(chunk, return_index=True)
                parts = np.split(a[at], starts[1:])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([row["p"]] * len(ids), pa.int64()), pa.array([packed(x) for x in parts], pa.binary())], names=["chunk", "p", "alpha"])

    return contexts.where("c1 is not null").join(of_p, F.col("p") == F.col("hot_p"), "left").select("p", "v", "cv", "n", "w", "q", "c1", "c2", "hot").mapInArrow(replies, "chunk long, p long, alpha binary")


def evaluated(chunks: DataFrame, replies: DataFrame, unigrams: Unigrams, d: np.ndarray, partitions: int, hot: int) -> DataFrame:
    """Scores of the chunks' documents from replies (chunk, p, n, alpha)."""
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                x = Pairs(row, unigrams.documents, partitions, hot)
                count, weight = np.zeros(len(x.v), "i8"), np.ones(len(x.v))
                for r in row["replies"]:
                    if r["n"] is not None:
                        count[x.order[x.ends[r["p"]] : x.ends[r["p"] + 1]]] = unpacked(r["n"], "u4")
                for r in row["replies"]:
                    if r["alpha"] is not None:
                        at = x.order[x.ends[r["p"]] : x.ends[r["p"] + 1]]
                        weight[at[(count[at] == 0) & (x.cv[at] > 0)]] = unpacked(r["alpha"], "f8")
                log_p = np.log10(np.where(count > 0, share(count, x.cv, d), weight * unigrams.p(x.cw)))
                base = np.log10((x.c + 0.1) / (unigrams.tokens + 0.1 * (unigrams.types + 1)))
                of_doc = lambda a: np.add.reduceat(a, x.starts)  # noqa: B023, E731
                n = len(x.lengths)
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(x.lengths), pa.array(of_doc((x.c[x.at] > 0).astype("i8"))), pa.array(np.full(n, unigrams.tokens)), pa.array(of_doc(base[x.at])), pa.array(of_doc(log_p[x.inverse]))], names=[f.split()[0] for f in schema.split(", ")])

    grouped = replies.groupBy(F.col("chunk").alias("of")).agg(F.collect_list(F.struct("p", "n", "alpha")).alias("replies"))
    both = chunks.join(grouped, F.col("chunk") == F.col("of")).select("doc_ids", "held", "lengths", "tokens", "c", "w_id", "replies")
    return both.mapInArrow(run, schema)


def score_documents(docs: DataFrame, folds: int = 10, held_out: int = 0, chunk: int = CHUNK, pairs: int = PAIRS, hot: int = HOT, shared: int = SHARED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    Documents whose crc32(doc_id as text) mod folds is held_out are scored, but not learned from.
    """
    texts = written(chunked(docs, held_out, folds, chunk), "lm-texts")
    chunks = written(with_counts(texts, shared), "lm-chunks")
    discard(texts)
    add = lambda col, start: F.aggregate(col, F.lit(start).cast("long"), lambda n, x: n + x)
    trained = F.zip_with("lengths", "held", lambda n, h: F.when(h, 0).otherwise(n))
    all_tokens, tokens, documents, types = (int(x or 0) for x in chunks.agg(F.sum(add(F.transform("lengths", lambda n: n.cast("long")), 0)), F.sum(add(F.transform(trained, lambda n: n.cast("long")), 0)), F.sum(F.size(F.filter("held", lambda h: ~h))), F.sum("types")).first())
    of_counts = summed(chunks, "of_counts")
    d1 = discounts(of_counts)
    many = tokens - float((of_counts[:K] * np.arange(1, K + 1)).sum())
    unknown = 1 - float((of_counts[:K] * d1[1:] * np.arange(1, K + 1)).sum()) / max(tokens, 1) - many / (tokens + 1.0)
    unigrams = Unigrams(tokens, types, documents, d1, max(unknown, 1e-300))
    partitions = max(1, math.ceil(all_tokens / pairs))
    model = written(counted_pairs(sent_pairs(chunks, documents, partitions, hot), unigrams), "lm-ngrams", by="kind")
    contexts = model.where("kind = 'contexts'")
    d2 = discounts(summed(contexts, "of_counts"))
    alphas = backoff_replies(contexts, d2, hot)
    replies = model.where("kind = 'reply'").select("chunk", "p", "n", F.lit(None).cast("binary").alias("alpha")).unionByName(alphas.select("chunk", "p", F.lit(None).cast("binary").alias("n"), "alpha"))
    return evaluated(chunks, replies, unigrams, d2, partitions, hot)
