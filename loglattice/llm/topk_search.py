"""Exact top-k by Hamming distance over binary codes: incremental multi-index hashing.

A code is the signs of a vector's components. Rows are dealt to blocks of bounded size; each block is indexed by
16-bit segments of the code. A query looks its segments up at growing radii, one segment at a time, and verifies
what it meets; having searched radius r in segments up to j, and r - 1 in the others, it has met every code within
distance m * r + j of m segments. It stops when its k-th distance is covered. The best k of each block meet by query.

A stated query set is held against all rows: blocks of rows are large (a million codes are 16 MB), so that radii stay
small and few blocks answer each query. A task has a block of rows, in pieces, and a share of the blocks of queries,
which come to it one after another; shares are so many that all cores have work where blocks are few, and that no
task has more than TASK_QUERIES. Equal codes are one entry with the k smallest ids, so that a frequent vector costs no
more than others.

Edge cases: rows with a null id or vector, with a null component, or with another number of components than the
first row by id, are neither found nor queries; NaN counts as negative; distances tie by id; a query finds itself;
fewer than k rows give what there is; repeated rows are found each, and a repeated query id gets one answer; an
empty table gives an empty result; extra columns have no effect.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of a block of the index, of a piece in which it travels, of a block of queries, and of a task's queries, about.
ROWS_BLOCK, PIECE, QUERY_BLOCK, TASK_QUERIES = 1_000_000, 8_192, 256, 200_000


def codes_of(vectors: DataFrame) -> DataFrame:
    """vec_id, code (packed bits, padded with zeros to 16) of the rows that can be searched."""
    clean = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"]).where("vec_id is not null and embedding is not null and not exists(embedding, x -> x is null)")
    width = F.size("embedding").alias("width")
    first = clean.select("vec_id", width).orderBy("vec_id", "width").limit(1).collect()
    wide = first[0].width if first else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and wide:
                bits = batch["embedding"].flatten().to_numpy(zero_copy_only=False).reshape(-1, wide) >= 0
                bits = np.pad(bits, ((0, 0), (0, -wide % 16)))
                packed = np.packbits(bits, axis=1, bitorder="little")
                yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array([r.tobytes() for r in packed], pa.binary())], names=["vec_id", "code"])

    return clean.where(F.size("embedding") == wide).mapInArrow(run, "vec_id long, code binary")


class Block:
    """Distinct codes of a block, each with its k smallest ids, indexed by segment."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, k: int):
        order = np.lexsort((ids, *codes.T[::-1]))
        ids, codes = ids[order], codes[order]
        new = np.append(True, (codes[1:] != codes[:-1]).any(axis=1)) if len(codes) else np.zeros(0, bool)
        self.starts = np.flatnonzero(new)
        self.ends = np.minimum(self.starts + k, np.append(self.starts[1:], len(ids)))
        self.ids, self.codes, self.k = ids, codes[self.starts], k
        self.orders = [np.argsort(s, kind="stable").astype("i4") for s in self.codes.T]
        self.sorted = [s[o] for s, o in zip(self.codes.T, self.orders, strict=True)]
        self.masks: list[np.ndarray] = []

    def of_radius(self, r: int) -> np.ndarray:
        while len(self.masks) <= r:
            n = len(self.masks)
            self.masks.append(np.array([sum(1 << b for b in c) for c in combinations(range(16), n)], "u2"))
        return self.masks[r]

    def search(self, code: np.ndarray) -> list[tuple[int, int]]:
        """The k nearest (distance, id)."""
        m = len(code)
        met = np.zeros(len(self.codes), bool)
        near: list[tuple[int, int]] = []
        for r in range(17):
            for j in range(m):
                values = code[j] ^ self.of_radius(r)
                low, high = np.searchsorted(self.sorted[j], values, "left"), np.searchsorted(self.sorted[j], values, "right")
                hit = high > low
                if hit.any():
                    found = np.concatenate([self.orders[j][a:b] for a, b in zip(low[hit], high[hit], strict=True)])
                    found = found[~met[found]]
                    met[found] = True
                    distances = np.bitwise_count(self.codes[found] ^ code).sum(axis=1)
                    worst = near[self.k - 1][0] if len(near) >= self.k else 16 * m
                    close = np.flatnonzero(distances <= worst)
                    if len(close) > self.k:  # what is further than the k-th of these is not among the best
                        close = close[distances[close] <= np.partition(distances[close], self.k - 1)[self.k - 1]]
                    near += [(int(distances[x]), int(i)) for x in close for i in self.ids[self.starts[found[x]] : self.ends[found[x]]]]
                    near = sorted(near)[: self.k]
                if len(near) >= self.k and near[-1][0] <= m * r + j:
                    return near
            if met.all():
                break
        return near


def nearest(vectors: DataFrame, k: int = 10, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, distance: the k nearest rows of vectors (vec_id, embedding) of each row whose id is divisible by every."""
    codes = written(codes_of(vectors), "codes", row_id="row")
    n = codes.count()
    asked = codes.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    q = asked.count()
    row_blocks, query_blocks = max(1, math.ceil(n / ROWS_BLOCK)), max(1, math.ceil(q / QUERY_BLOCK))
    cores = codes.sparkSession.sparkContext.defaultParallelism
    shares = min(query_blocks, max(math.ceil(cores / row_blocks), math.ceil(q / TASK_QUERIES)))
    packed = lambda df, pieces: df.groupBy(F.pmod(F.xxhash64("row"), F.lit(pieces)).cast("int").alias("piece")).agg(F.collect_list(F.struct("vec_id", "code")).alias("rows"))
    every_one = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    pieces = packed(codes, max(row_blocks, math.ceil(n / PIECE))).select((F.col("piece") % row_blocks).alias("block"), every_one(shares).alias("share"), F.lit(False).alias("asks"), "rows")
    parts = packed(asked, query_blocks).select(every_one(row_blocks).alias("block"), (F.col("piece") % shares).alias("share"), F.lit(True).alias("asks"), "rows")
    both = pieces.unionByName(parts).select((F.col("block") * shares + F.col("share")).alias("task"), "asks", "rows").repartitionById(row_blocks * shares, F.col("task")).sortWithinPartitions("task", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                task, ids, found = batch["task"][i].as_py(), *_arrays(batch["rows"][i].values)
                if task != at:
                    at, held, index = task, [], None
                if not batch["asks"][i].as_py():
                    held.append((ids, found))
                    continue
                if index is None and held:
                    index = Block(*(np.concatenate(x) for x in zip(*held, strict=True)), k)
                    held = []
                if index is None:  # no row was dealt to this block
                    continue
                best = [(int(one), v, d) for one, code in zip(ids, found, strict=True) for d, v in index.search(code)]
                cols = list(zip(*best, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "distance"])

    best = both.mapInArrow(run, "query_id long, vec_id long, distance long")
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def _arrays(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    codes = rows.field("code").to_pylist()
    return rows.field("vec_id").to_numpy(zero_copy_only=False), np.frombuffer(b"".join(codes), "u2").reshape(len(codes), -1)
