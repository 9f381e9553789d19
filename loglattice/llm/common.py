"""What several operators share: the shared folder, written tables, row selection."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: The white space of the contracts' words, as a Java and a Python character class.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a batch of rows that goes to Python, about, while a table is written.
BATCH = 4_000_000


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, after which the worker gives free memory back to the system: workers stay for later steps, beside the executor."""

    @functools.wraps(run)
    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
            trim(0)

    return then


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str = "table", row_id: str | None = None, codec: str = "zstd", by: str | None = None) -> DataFrame:
    """Writes df once to the shared folder and reads it back: lineage ends here, and a lost executor costs no recomputation.

    row_id: name of a column of unique numbers, which stay as they were written. by: column to partition the table by.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if row_id:
        df = df.withColumn(row_id, F.monotonically_increasing_id())
    # else joins on unions may fail once their inputs are coalesced: "Can't zip RDDs with unequal numbers of partitions"
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    # the exchanges of this write are not needed once it is done, and rows with texts or packed numbers may be large
    for_now = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH)}
    before = {k: spark.conf.get(k, None) for k in for_now}
    try:
        for k, v in for_now.items():
            spark.conf.set(k, v)
        df.write.option("compression", codec).parquet(path, partitionBy=by)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)  # a partition column comes last


def discard(table: DataFrame) -> None:
    """Removes the files of a table that written() made, once nothing will read it again."""
    sc = table.sparkSession.sparkContext
    for file in table.inputFiles()[:1]:
        folder = sc._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def packed_rows(docs: DataFrame) -> Column:
    """All columns as one, `row`, so that no name can clash."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")


def remainder(docs: DataFrame, by: int) -> Column:
    """crc32(doc_id as text) mod by; a null id counts as empty text."""
    return F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")) % by


def text_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"], F.lit(""))


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is evaluated once, however often then uses it."""
    return F.transform(F.array(value), then)[0]


def uniform(*cols: Column | str) -> Column:
    """A number in (0, 1) that depends on the columns' values only."""
    return (F.xxhash64(*cols).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)


def regrouped(df: DataFrame, *keys: str) -> DataFrame:
    """df, as if it were not yet partitioned by keys: for the aggregated side of a join on them.

    Otherwise that side keeps its partitioning, and a key that holds many rows of the other side stays in one task;
    as it is, both sides are dealt out for the join, and Spark splits such keys.
    """
    return df.withColumns({k: F.array_max(F.array(k)) for k in keys})


def might_be_in(number: Column, wanted: DataFrame, name: str, log_size: int = 20) -> Column:
    """A filter that keeps every row whose number is in wanted[name], and few others while wanted is small.

    It is a bitmap of 2 ** log_size hashed numbers, so the driver gets 128 KB at most; a join must follow.
    """
    slot = F.pmod(F.xxhash64(wanted[name]), F.lit(1 << log_size))
    words = wanted.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(63).cast("int"))).alias("bits")).collect()
    bitmap = [0] * (1 << (log_size - 6))
    for row in words:
        bitmap[row["at"]] = row["bits"]
    mine = F.pmod(F.xxhash64(number), F.lit(1 << log_size))
    return F.getbit(F.get(F.split(F.lit(",".join(map(str, bitmap))), ",").cast("array<bigint>"), F.shiftright(mine, 6).cast("int")), mine.bitwiseAND(63).cast("int")) == 1


def has_unique_ids(rows: DataFrame) -> bool:
    """Whether doc_id is never null and never repeated."""
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").isEmpty()


def with_copies(docs: DataFrame, decisions: DataFrame, unique: bool) -> DataFrame:
    """docs' rows, each as often as decisions say: (doc_id, text_key, copies), one row for each row of docs.

    text_key is xxhash64 of the text. Where ids are unique, doc_id alone finds the row. Otherwise rows with equal
    doc_id and text count as one document: one of them stands for all, as often as their copies say together.
    """
    packed = docs.select(packed_rows(docs), docs["doc_id"].alias("id"), (F.lit(0) if unique else F.xxhash64(text_of(docs))).alias("tk"))
    wanted = decisions.where("copies > 0")
    if unique:
        wanted = wanted.select(F.col("doc_id").alias("id2"), "copies")
        joined = packed.join(wanted, F.col("id") == F.col("id2"))
    else:
        packed = packed.groupBy("id", "tk").agg(F.first("row").alias("row"))
        wanted = wanted.groupBy(F.col("doc_id").alias("id2"), F.col("text_key").alias("tk2")).agg(F.sum("copies").alias("copies"))
        joined = packed.join(wanted, F.col("id").eqNullSafe(F.col("id2")) & (F.col("tk") == F.col("tk2")))
    return joined.select("row", F.explode(F.expr("sequence(1, cast(copies as int))")).alias("nth")).select("row.*")
