"""Training-data pipeline: five stages over documents, each written as Parquet and reread as the next one's input.

Edge cases: a null or empty text has no language and goes in the first stage; of equal texts one stays, repeated rows
and null doc_ids included; texts of any length are taken whole; a null source is a source of its own; columns beside
those of documents, whatever their names, are carried along up to the last stage; empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loglattice.llm.common import discard, table, written
from loglattice.llm.exact_dedup import drop_exact_copies
from loglattice.llm.language_id import drop_unidentified
from loglattice.llm.minhash_dedup import drop_near_duplicates
from loglattice.llm.mixing import mixed_documents
from loglattice.llm.packing import packed_pieces

TOKENIZER = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undetermined or in doubt go."""
    return drop_unidentified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document appears as often as the mix takes it."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packed_pieces(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language_id", language), ("exact_dedup", exact), ("minhash_dedup", near), ("mixing", mix), ("packing", pack)]

#: Language models, signatures and tokens are beyond SQL: tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table of documents. A stage's output is removed once the next one's is written."""
    docs, former = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}", codec="snappy")
        if former:
            discard(former)
        former = docs
    packed = STAGES[-1][1](spark, docs, sf_dir)  # its pieces are written by now
    discard(docs)
    return packed
