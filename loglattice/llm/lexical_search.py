"""Ranked lexical search by pipelined term partitioning, in 64-bit integers.

One pass over the documents makes blocks of postings, of the terms that items may ask for. Terms have owners, one for
each stage, by how many documents hold them, rarest first. Items travel in bundles: for each block of documents a
bundle carries a sparse accumulator for each of its items, scores by document, from owner to owner; at each stage it
meets, by cogroup, the owner's postings of its block and takes their integer contributions. A bundle knows how much
the later owners can still add to an item: documents that even so stay under the block's k best go, and the item takes
no new ones. That drops nothing that the result could hold. The last stage leaves k documents for each item and block,
of which the final selection takes the best.

Memory: a task holds one block and one bundle, at most BLOCK documents by BUNDLE items, and a block's postings, which
end a block at POSTINGS. What items ask for reaches the pass over documents as a bitmap of 1 MB, however many terms
there are, and a join drops what it lets through in error.

Edge cases: null texts have no terms and don't count as documents; a document without an id can be found, ranked after
others of its score; repeated rows are documents each, in any order; repeated items count once, and different texts of
one item_id are taken together; an item without terms, or whose terms no document has, gets no rows; an empty table
gives an empty result; extra columns have no effect.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

#: What is no term to a space, upper case to lower, in bytes; and terms as a Java pattern.
TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents and postings of a block at most; items of a bundle, about; bits of the bitmap of terms.
BLOCK, POSTINGS, BUNDLE, SLOTS = 8192, 2_000_000, 256, 1 << 23
#: Owners of terms: each has those that more than so large a share of the documents hold, up to the next one's.
OWNERS = (0.0, 1 / 256, 1 / 32, 1 / 4)
# The score's constants.
UNIT, TF, NORM, BASE, SLOPE = 1_000_000_000, 1000, 12, 75, 25

BUNDLES = "bundle int, block long, item long, closed boolean, docs binary, scores binary, ids array<long>"


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def item_terms(items: DataFrame) -> DataFrame:
    """item, bundle, item_id, term, n: how often an item asks for a term."""
    whole = items.select(items["item_id"].cast("long").alias("item_id"), items["text"]).distinct()
    counted = whole.select("item_id", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("n"))
    names = written(counted.select("item_id").distinct(), "search-items", row_id="item")
    bundles = max(1, -(-names.count() // BUNDLE))
    named = names.select("item", F.pmod(F.xxhash64("item"), F.lit(bundles)).cast("int").alias("bundle"), F.col("item_id").alias("id"))
    return written(counted.join(named, F.col("item_id").eqNullSafe(F.col("id"))).drop("id"), "search-terms")


def bitmap_of(terms: DataFrame) -> bytes:
    """A bit for each slot of hashed terms that items ask for."""
    slot = F.crc32(F.col("term").cast("binary")) % SLOTS
    words = terms.select(slot.alias("slot")).groupBy(F.shiftright("slot", 5).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(31).cast("int"))).alias("bits")).collect()
    bitmap = np.zeros(SLOTS // 32, dtype="<u4")
    for at, bits in words:
        bitmap[at] = bits
    return bitmap.tobytes()


def block_postings(docs: DataFrame, bitmap: bytes) -> DataFrame:
    """block, term, docs, tfs, ids: a row for each block and term that may be wanted; for each block one of its documents'
    ids and, as tfs, their lengths; and for each task one, of block -1, with the numbers of its documents and terms."""
    names = ["block", "term", "docs", "tfs", "ids"]
    types = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64())]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, bits = TaskContext.get().partitionId() << 31, np.frombuffer(bitmap, np.uint8)
        wanted: dict[bytes, bool] = {}
        ids, lengths, found, size, totals = [], [], {}, 0, [0, 0]

        def rows() -> Iterator[pa.RecordBatch]:
            whole = [(block, None, None, np.array(lengths, "<i8").tobytes(), ids)]
            whole += [(block, term.decode("utf-8", "replace"), np.array(x[::2], "<i4").tobytes(), np.array(x[1::2], "<i4").tobytes(), None) for term, x in found.items()]
            for at in range(0, len(whole), 20_000):
                yield batch_of(whole[at : at + 20_000])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").translate(TO_TERMS).split()
                if not words:
                    continue
                totals = [totals[0] + 1, totals[1] + len(words)]
                for term, n in Counter(words).items():
                    if (hit := wanted.get(term)) is None:
                        slot = zlib.crc32(term) % SLOTS
                        hit = bool(bits[slot >> 3] >> (slot & 7) & 1)
                        if len(wanted) < 1_000_000:
                            wanted[term] = hit
                    if hit:
                        found.setdefault(term, []).extend((len(ids), n))
                        size += 1
                ids.append(doc_id)
                lengths.append(len(words))
                if len(ids) == BLOCK or size >= POSTINGS:
                    yield from rows()
                    block, ids, lengths, found, size = block + 1, [], [], {}, 0
        if ids:
            yield from rows()
        yield batch_of([(-1, None, None, np.array(totals, "<i8").tobytes(), None)])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, "block long, term string, docs binary, tfs binary, ids array<long>")


def collection_sizes(postings: DataFrame) -> tuple[int, int]:
    """Documents and terms of the whole collection, from one row for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2, np.int64)
        for batch in batches:
            for x in batch["tfs"]:
                total += np.frombuffer(x.as_py(), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([int(total[0])]), pa.array([int(total[1])])], names=["n", "l"])

    row = postings.where("block = -1").select("tfs").mapInArrow(run, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return row[0] or 0, row[1] or 0


def owned_terms(terms: DataFrame, postings: DataFrame, documents: int) -> DataFrame:
    """owner, bundle, term, weight, items, ns, later: for each term the items that ask for it, how often, and how much
    later owners can add to each."""
    df = postings.where("term is not null").groupBy("term").agg(F.sum(F.octet_length("docs") / 4).cast("long").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1)))
    owner = sum((F.col("df") > share * documents).cast("int") for share in OWNERS[1:])
    weighed = terms.join(df, "term").withColumn("weight", weight).withColumn("owner", owner).where("weight > 0")
    # a document gets less than UNIT / TF times a term's weight
    most = weighed.groupBy("item", "owner").agg(F.sum(F.col("weight") * F.col("n")).alias("m"))
    later = most.withColumn("later", F.coalesce(F.sum("m").over(Window.partitionBy("item").orderBy("owner").rowsBetween(1, Window.unboundedFollowing)), F.lit(0)) * (UNIT // TF)).drop("m")
    return weighed.join(later, ["item", "owner"]).groupBy("owner", "bundle", "term", "weight").agg(F.collect_list(F.struct("item", "n", "later")).alias("of"))


def stage(k: int, last: bool):
    """A bundle's visit to an owner, for cogroup: the bundle's rows of a block, and the owner's postings of it."""

    def visit(bundle: pa.Table, owned: pa.Table) -> pa.Table:
        ids, norms, items, scores, closed = [], np.zeros(0, np.int64), {}, [], []
        rows = bundle.to_pylist()
        for r in rows:
            if r["item"] is None:
                ids, norms = r["ids"], np.frombuffer(r["scores"], "<i8")
        for r in rows:
            if r["item"] is not None:
                items[r["item"]] = len(items)
                dense = np.zeros(len(norms), np.int64)
                dense[np.frombuffer(r["docs"], "<i4")] = np.frombuffer(r["scores"], "<i8")
                scores.append(dense)
                closed.append(dense > 0 if r["closed"] else None)
        later = {}
        for docs, tfs, weight, of in zip(*(owned[c].to_pylist() for c in ("docs", "tfs", "weight", "of")), strict=True):
            at, tf = np.frombuffer(docs, "<i4"), np.frombuffer(tfs, "<i4").astype(np.int64)
            adds = weight * (UNIT * tf // (TF * tf + NORM * norms[at]))
            for x in of:
                i = items.setdefault(x["item"], len(items))
                if i == len(scores):
                    scores.append(np.zeros(len(norms), np.int64))
                    closed.append(None)
                later[i] = x["later"]
                scores[i][at] += x["n"] * adds
        out = []
        for item, i in items.items():
            mine = scores[i] if closed[i] is None else np.where(closed[i], scores[i], 0)
            kept, shut = np.flatnonzero(mine), closed[i] is not None
            if len(kept) > k:
                least = np.partition(mine[kept], -k)[-k]
                if last or i in later and later[i] < least:
                    kept, shut = kept[mine[kept] + (0 if last else later[i]) >= least], True
            if last:
                best = sorted((-int(mine[d]), ids[d] is None, ids[d] or 0, int(d)) for d in kept)[:k]
                out += [(item, ids[d], -s) for s, _, _, d in best]
            else:
                out.append((rows[0]["bundle"], rows[0]["block"], item, shut, kept.astype("<i4").tobytes(), mine[kept].tobytes(), None))
        if last:
            return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ((), (), ()))], names=["item", "doc_id", "score"])
        head = next(r for r in rows if r["item"] is None)
        out.append(tuple(head.values()))
        types = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=list(head))

    return visit


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k documents of the highest scores over 0, equal ones by doc_id."""
    terms = item_terms(items)
    postings = written(block_postings(docs, bitmap_of(terms)), "search-postings")
    documents, length = collection_sizes(postings)
    owned = written(owned_terms(terms, postings, documents), "search-owned")
    most = terms.agg(F.max("bundle")).first()[0] or 0
    norms = _norms(postings.where("block >= 0 and term is null"), documents, max(1, length))
    travelling = norms.withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(most))))
    travelling = travelling.select("bundle", "block", F.lit(None).cast("long").alias("item"), F.lit(False).alias("closed"), F.lit(None).cast("binary").alias("docs"), "scores", "ids")
    for i in range(len(OWNERS)):
        mine = owned.where(F.col("owner") == i).select("bundle", F.col("term").alias("t"), "weight", "of")
        met = postings.where("term is not null").join(mine, F.col("term") == F.col("t")).select("bundle", "block", "docs", "tfs", "weight", "of")
        last = i == len(OWNERS) - 1
        travelling = travelling.groupBy("bundle", "block").cogroup(met.groupBy("bundle", "block")).applyInArrow(stage(k, last), "item long, doc_id long, score long" if last else BUNDLES)
    ranked = travelling.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))).where(F.col("rank") <= k)
    found = written(ranked, "search-found")
    names = terms.select("item", "item_id").distinct()
    result = found.join(names, "item").select("item_id", "rank", "doc_id", "score")
    discard(postings)
    return result


def _norms(heads: DataFrame, documents: int, length: int) -> DataFrame:
    """block, ids, scores: for each document of a block what its length adds to a score's divisor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(BASE + SLOPE * np.frombuffer(x.as_py(), "<i8") * documents // length).tobytes() for x in batch["tfs"]]
            yield pa.RecordBatch.from_arrays([batch["block"], batch["ids"], pa.array(made, pa.binary())], names=["block", "ids", "scores"])

    return heads.select("block", "ids", "tfs").mapInArrow(run, "block long, ids array<long>, scores binary")
