"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame functions only.

Each document draws an exponential key scaled by its quality weight; within a source, documents are ordered by
key and their sizes summed up to the token budget. Complete epochs precede: a budget of 1.4 times the source
takes every document once, then a sample of 0.4. The document at which a budget ends is taken in part; where documents must
stay whole, as in the pipeline, the one document that is left and closes the gap best follows instead.

A source may hold a third of all rows, so running sums are taken in slices of the key's range and then offset.
Edge cases: a null text has size 0 and takes no words; a null source is a source, the last in order; an empty
table gives an empty result; repeated rows each count; keys depend on doc_id alone, so that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, has_unique_ids, text_of, uniform, with_copies, written

WEIGHTS = (5.0, 2.0, 1.0)
#: Rows of a slice, about.
SLICE = 4096
#: A word of letters alone, with a comma or full stop at most.
PLAIN_WORD = r"(?<![^\x20\x09-\x0D])\p{L}++[.,]?(?![^\x20\x09-\x0D])"


def quality_of(docs: DataFrame) -> Column:
    """Quality weight: the share of words that are plain, between 0.05 and 1."""
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.regexp_count(text_of(docs), F.lit(PLAIN_WORD)) / F.greatest(F.lit(1), F.regexp_count(text_of(docs), F.lit(WORD)))))


def source_targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """sources (source, source_size, ...) with target: the weights' shares of share * all sizes, none above most * its size.

    In order of cap / weight, the sources before the level are full; the level is what is left by weight. Windows
    here span one row for each source.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    order, every = Window.orderBy("ratio", "rank"), Window.partitionBy()
    ranked = ranked.withColumn("left", share * F.sum("source_size").over(every) - F.sum("cap").over(order) + F.col("cap")).withColumn("by", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    ranked = ranked.withColumn("level", F.col("left") / F.col("by"))
    level = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "rank", "level"))).over(every)["level"]
    return ranked.withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("weight") * level), F.col("cap"))).drop("rank", "cap", "ratio", "left", "by", "level", "weight")


def sized_rows(docs: DataFrame, quality: Column | None, seed: int) -> DataFrame:
    rows = docs.select(docs["doc_id"], docs["source"], F.xxhash64(text_of(docs)).alias("text_key"), F.regexp_count(text_of(docs), F.lit(WORD)).cast("long").alias("size"), (quality_of(docs) if quality is None else quality).alias("quality"))
    return written(rows.withColumn("key", -F.log(uniform("doc_id", F.lit(seed))) / F.col("quality")), "mixing-rows", row_id="row_id")


def take_words(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, quality: Column | None = None, seed: int = 7, rows: DataFrame | None = None) -> DataFrame:
    """doc_id, text_key, source, size, source_size, target, taken, and what copies are made from: one row for each row of docs.

    taken: the words that the mix takes of the document, repeats counted. The document at which its source's budget ends is
    taken in part, up to the budget's last word, so that each source meets its target to the word.
    """
    rows = sized_rows(docs, quality, seed) if rows is None else rows
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"), F.avg("quality").alias("q"))
    sources = written(source_targets(sources, share, most, weights).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mixing-sources")
    of = sources.select(F.col("source").alias("s"), "n", "q", "source_size", "target", "epochs", "rest")
    slices = F.greatest(F.lit(1), F.ceil(F.col("n") / SLICE))
    cut = rows.join(of, F.col("source").eqNullSafe(F.col("s"))).withColumn("slice", F.least(slices - 1, F.floor((1 - F.exp(-F.col("key") * F.col("q"))) * slices)))
    totals = cut.groupBy("s", "slice").agg(F.sum("size").alias("of_slice"))
    before = totals.select(F.col("s").alias("s2"), F.col("slice").alias("slice2"), (F.sum("of_slice").over(Window.partitionBy("s").orderBy("slice")) - F.col("of_slice")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("s", "slice").orderBy("key", "doc_id", "size", "text_key", "row_id").rowsBetween(Window.unboundedPreceding, 0))
    summed = cut.withColumn("inside", inside).join(before, F.col("s").eqNullSafe(F.col("s2")) & (F.col("slice") == F.col("slice2")))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.floor(F.col("rest")) - F.col("upto") + F.col("size")))
    return written(summed.withColumn("upto", F.col("before") + F.col("inside")).withColumn("chosen", (F.col("upto") <= F.col("rest")) & (F.col("epochs") < most)).select("row_id", "doc_id", "text_key", "source", "size", "source_size", "target", "epochs", "rest", "key", "upto", "chosen", (F.col("epochs") * F.col("size") + F.when(F.col("epochs") < most, part).otherwise(0)).cast("long").alias("taken")), "mixing-chosen")


def mix_sources(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, quality: Column | None = None, seed: int = 7, rows: DataFrame | None = None) -> DataFrame:
    """doc_id, text_key, source, size, source_size, target, taken, as take_words has them, and copies: how often the mix takes
    the document where documents stay whole. Then one document a source closes the gap, if that brings it nearer its target."""
    chosen = take_words(docs, share, most, weights, quality, seed, rows)
    gaps = chosen.groupBy("source").agg((F.first("rest") - F.coalesce(F.max(F.when(F.col("chosen"), F.col("upto"))), F.lit(0))).alias("gap")).select(F.col("source").alias("s"), "gap")
    fits = chosen.where(~F.col("chosen") & (F.col("epochs") < most)).join(gaps, F.col("source").eqNullSafe(F.col("s")))
    closing = fits.groupBy("s").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "key", "row_id", "gap")).alias("f")).where("f.off < f.gap").select(F.col("s"), F.col("f.row_id").alias("closing_id"))
    copies = (F.col("epochs") + (F.col("chosen") | F.coalesce(F.col("row_id") == F.col("closing_id"), F.lit(False))).cast("int")).cast("long")
    return chosen.join(closing, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("copies", copies).select("doc_id", "text_key", "source", "size", "source_size", F.col("target").cast("double").alias("target"), "copies", "taken")


def mixed_documents(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """docs' rows, each as often as the mix takes it; documents that it leaves out go."""
    rows = sized_rows(docs, None, seed)
    return with_copies(docs, mix_sources(docs, share, most, weights, seed=seed, rows=rows), has_unique_ids(rows))
