"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only.

drop_exact_copies reads and hashes whole texts only of documents that share length and prefix with another one;
exact_dedup returns every document's digest, and takes it in the first reading.

Edge cases: a null text counts as empty; empty texts are equal to each other and to texts of white space alone.
Every row of the input gets a row, repeated rows too, of which one at most is kept. A null doc_id sorts last.
An empty table gives an empty result. Extra columns, whatever their names, have no effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK, has_unique_ids, might_be_in, packed_rows, regrouped, text_of, written

PREFIX = 256


def document_keys(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """One narrow row for each document, from one read of the texts: a text column is stored and read as a whole,
    so the full digest, which every caller gets back, is taken in the same pass. What the refinement spares is
    the grouping on it: only rows that share length and prefix go to that exchange."""
    bare = docs.select(docs["doc_id"], F.char_length(text_of(docs)).alias("n_chars"), F.xxhash64(text_of(docs)).alias("text_key"), F.regexp_replace(text_of(docs), BLANK, "").alias("bare"))
    keys = bare.select("doc_id", "n_chars", "text_key", F.char_length("bare").alias("n_bare"), F.xxhash64(F.substring("bare", 1, prefix)).alias("prefix_hash"), F.unhex(F.sha2("bare", 256)).alias("digest"))
    return written(keys, "dedup-keys", row_id="row_id")


def survivors(keys: DataFrame) -> DataFrame:
    """Rows that share their length, and then their prefix hash, with another row."""
    lengths = keys.groupBy("n_bare").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = keys.select("n_bare", "prefix_hash").join(regrouped(lengths, "n_bare"), "n_bare", "left_semi").groupBy("n_bare", "prefix_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return keys.join(regrouped(shared, "n_bare", "prefix_hash"), ["n_bare", "prefix_hash"], "left_semi")


def exact_dedup(docs: DataFrame, prefix: int = PREFIX, keys: DataFrame | None = None) -> DataFrame:
    """doc_id, text_key, keep_id, group_size, kept, text_sha256: one row for each row of docs.

    Of equal texts (white space aside), the row with the most code points stays, then that of the smallest doc_id.
    """
    keys = document_keys(docs, prefix) if keys is None else keys
    order = F.struct((-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("row_id").alias("d"))
    groups = survivors(keys).groupBy("digest").agg(F.count(F.lit(1)).alias("size"), F.min(order).alias("best")).where("size > 1")
    alone = F.col("best").isNull()
    return keys.join(regrouped(groups, "digest"), "digest", "left").select(
        "doc_id",
        "text_key",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.c")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row_id") == F.col("best.d"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def shared_prefixes(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """doc_id, shared, as many as docs has rows: whether another row has the same length and the same prefix.

    No text is hashed as a whole here. The prefix is taken from the text's first characters, unless white space
    leaves too few of them.
    """
    text = text_of(docs)
    head = F.regexp_replace(F.substring(text, 1, 4 * prefix), BLANK, "")
    enough = F.when(F.char_length(head) >= prefix, head).otherwise(F.regexp_replace(text, BLANK, ""))
    bare = docs.select(docs["doc_id"], (F.char_length(text) - F.regexp_count(text, F.lit(BLANK))).alias("n_bare"), F.xxhash64(F.substring(enough, 1, prefix)).alias("prefix_hash"))
    rows = written(bare, "dedup-prefixes", row_id="row_id")
    mine = survivors(rows).select("row_id", F.lit(True).alias("shared"))
    return written(rows.select("row_id", "doc_id").join(mine, "row_id", "left").select("doc_id", F.coalesce("shared", F.lit(False)).alias("shared")), "dedup-shared")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """docs without the copies. Only documents that share length and prefix with another one are hashed as a whole."""
    rows = shared_prefixes(docs)
    unique, shared = has_unique_ids(rows), rows.where("shared").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"))
    if shared.isEmpty():
        return docs
    some = docs.where(might_be_in(F.coalesce(docs["doc_id"].cast("long"), F.lit(-1)), shared, "id"))
    of_row = F.count(F.lit(1)).alias("n"), F.sum(F.col("kept").cast("long")).alias("copies")
    gone = written(exact_dedup(some).groupBy("doc_id", "text_key").agg(*of_row).where("copies < n"), "dedup-gone")
    if unique:
        return docs.join(gone.select(F.col("doc_id").alias("id2")), docs["doc_id"] == F.col("id2"), "left_anti")
    packed = docs.select(packed_rows(docs), docs["doc_id"].alias("id"), F.xxhash64(text_of(docs)).alias("tk"))
    judged = packed.join(gone.select(F.col("doc_id").alias("id2"), F.col("text_key").alias("tk2"), "copies"), F.col("id").eqNullSafe(F.col("id2")) & (F.col("tk") == F.col("tk2")), "left")
    once = judged.where("copies = 1").groupBy("id", "tk").agg(F.first("row").alias("row"))
    return judged.where("copies is null").select("row").unionByName(once.select("row")).select("row.*")
