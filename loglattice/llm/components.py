"""Connected groups of a graph of links, and the search for links within buckets.

connected_components and linked use DataFrame functions only; links_within searches in Python within tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, giving_back, might_be_in, regrouped, written

#: Members up to which a bucket's pairs are all made; members of a block, about, in which the last search takes a larger
#: one; rounds with leaders; rounds at most of the grouping.
SMALL, CROWDED, LEADER_ROUNDS, MOST_ROUNDS = 8, 64, 2, 50
#: What a member brings besides its id: its size, and the first and last place of the key.
SIZES = ("size", "place", "last")


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that it is connected with) for the nodes of edges (a, b).

    Alternating large-star and small-star steps (Kiveris et al. 2014): each step is a join on nodes and a
    pre-aggregated minimum, written to the shared folder; rounds grow with the logarithm of a chain's length.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    last = None
    edges = written(edges, "links")
    for _ in range(MOST_ROUNDS):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(regrouped(least, "a"), "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        down = large.select(F.col("b").alias("node"), F.col("a").alias("low"))
        lowest = down.groupBy("node").agg(F.min("low").alias("m"))
        small = down.join(regrouped(lowest, "node"), "node").select(F.col("m").alias("a"), F.col("low").alias("b")).where("a < b").unionByName(lowest.select(F.col("m").alias("a"), F.col("node").alias("b")))
        edges = written(small.distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"links did not settle in {MOST_ROUNDS} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def linked(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], ratio: float = 0.0) -> DataFrame:
    """Links (a, b, a < b) between the ids of buckets (key, id, rank, size), enough to connect whatever verify finds linked.

    ratio: of linked ids, the smaller size is at least this share of the larger one. place: how much of its size an id
    has before what the key stands for (0 if left out): as much of both as lies apart before it and behind it is at most
    what ratio leaves of the larger size. An id may come with a key in several places. Buckets of more than SMALL are cut
    by it: into classes of size, each id in its own and in the next one, so that such ids share a class.

    verify takes distinct pairs (a, b) and returns those that hold. In a bucket of SMALL members at most, all pairs are
    made at once. In a larger one no more are made than it has members: they are held against a leader, first the one of
    highest rank, then the one with most links, and only buckets that still hold several components go on. At last, the
    pairs of different components that are left are all made, in crowded buckets by pairs of blocks, so that no task
    holds all of one.
    """
    if "place" not in buckets.columns:
        buckets = buckets.withColumn("place", F.lit(0))

    def near(a: str, b: str) -> Column:
        """Whether sizes and places allow it; where a key stands in several places, the nearest ones count."""
        (at_a, last_a), (at_b, last_b) = ([F.col(x.replace("size", of)) for of in ("place", "last")] for x in (a, b))
        before = F.greatest(F.lit(0), at_a - last_b, at_b - last_a)
        behind = F.greatest(F.lit(0), (F.col(a) - last_a) - (F.col(b) - at_b), (F.col(b) - last_b) - (F.col(a) - at_a))
        return before + behind <= (1 - ratio) * F.greatest(a, b) + 1e-9

    counts = written(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket-counts")
    met = written(buckets.where(might_be_in(F.col("key"), counts, "key")).groupBy("key", "id", "rank", "size").agg(F.min("place").alias("place"), F.max("place").alias("last")).join(regrouped(counts, "key"), "key"), "buckets")
    few = met.where(F.col("n") <= SMALL).select("key", F.col("id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in SIZES])
    pairs_of_few = few.join(few.select("key", F.col("a").alias("b"), *[F.col(f"{c}_a").alias(f"{c}_b") for c in SIZES]), "key").where((F.col("a") < F.col("b")) & near("size_a", "size_b")).select("a", "b")
    buckets = met.where(F.col("n") > SMALL).drop("n")
    if ratio:
        of_size = F.floor(F.log(F.greatest(F.lit(1), F.col("size"))) / -math.log(ratio))
        buckets = buckets.select(F.explode(F.array(of_size, of_size + 1)).alias("class"), "*").withColumn("key", F.xxhash64("key", "class")).drop("class")
        buckets = written(buckets, "buckets")
    tried = found = None
    members = buckets.withColumn("component", F.col("id"))
    for r in range(LEADER_ROUNDS + 1):
        if r:
            known = connected_components(found).select(F.col("node").alias("id"), "component")
            ends = found.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
            members = buckets.select("key", "id", *SIZES).join(known.join(ends, "id"), "id", "left").select("key", "id", *SIZES, F.coalesce("component", "id").alias("component"), F.coalesce("degree", F.lit(0)).alias("rank"))
            open_keys = members.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2").select("key")
            members = written(members.join(regrouped(open_keys, "key"), "key"), "members")
        if r < LEADER_ROUNDS:
            first = F.struct((-F.col("rank")).alias("r"), F.xxhash64("id").alias("h"), F.col("id").alias("leader"), F.col("component").alias("of"), *[F.col(c).alias(f"{c}_l") for c in SIZES])
            leaders = members.groupBy("key").agg(F.min(first).alias("f")).select("key", "f.leader", "f.of", *[f"f.{c}_l" for c in SIZES])
            pairs = members.join(regrouped(leaders, "key"), "key").where((F.col("component") != F.col("of")) & near("size", "size_l")).select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b"))
            pairs = (pairs if r else pairs.unionByName(pairs_of_few)).distinct()
        else:
            pairs = _rest(members, near)
        if r:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        if r and members.isEmpty():
            break
        held = written(verify(pairs), "links")
        found = held if found is None else found.unionByName(held)
        tried = pairs if tried is None else tried.unionByName(pairs)
    for used in (counts, met, buckets) if ratio else (counts, met):
        discard(used)
    return found


def _rest(members: DataFrame, near: Callable[[str, str], Column]) -> DataFrame:
    """All near pairs of different components within a bucket; a crowded one is held against itself block by block."""
    sizes = [c for c in SIZES if c in members.columns]
    counts = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.col("n") / CROWDED).cast("int")
    sized = members.join(regrouped(counts, "key"), "key").select("key", "id", *sizes, "component", blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", *sizes, "component")
    right = dealt.select("key", "low", "high", F.col("block").alias("block_b"), F.col("id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in sizes], F.col("component").alias("cb"))
    # a pair in one block meets once for each other block, and counts where the block is held against itself
    once = (F.col("low") == F.col("high")) | (F.col("block") != F.col("block_b"))
    return dealt.withColumnRenamed("id", "a").join(right, ["key", "low", "high"]).where((F.col("a") < F.col("b")) & (F.col("component") != F.col("cb")) & near("size", "size_b") & once).select("a", "b").distinct()


#: Members of each group that all its blocks hold.
LEADERS = 4


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows with equal keys, where rows come in order of keys; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch[k].to_numpy(zero_copy_only=False) for k in keys])
        cuts = [0, *(np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            now = tuple(columns[:, start])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def links_within(members: DataFrame, kind: type, block: int, *args) -> tuple[DataFrame, bool]:
    """Links (a, b) that connect whatever members of a group are similar; and whether each is a star of one search.

    members: key, id, n_bytes and kind's columns; kind(*columns, *args).like(i, others) gives those of others that i is
    similar to. Groups of more than block bytes are cut into blocks, all of which hold the group's leaders, so that
    a large group of copies is connected by work in proportion to its size. What is in other components than most of
    its group is then held against all of the group's blocks. Within a task, pairs that are connected already are
    passed over, and only links that connect are rows.
    """
    carried = list(kind.columns)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for rows in runs_of(batches, ["key", "block"]):
            ids, at = np.unique(rows["id"].to_numpy(), return_index=True)
            if len(ids) > 1:
                payload = kind(*([x[i] for i in at] for x in (rows[c].to_pylist() for c in carried)), *args)
                of = np.arange(len(ids))  # the smallest place of the component
                for i in range(len(ids)):
                    others = i + 1 + np.flatnonzero(of[i + 1 :] != of[i])
                    for j in payload.like(i, others) if len(others) else ():
                        if of[i] != of[j]:
                            low, high = sorted((of[i], of[j]))
                            of[of == high] = low
                linked = np.flatnonzero(of != np.arange(len(ids)))
                a += ids[of[linked]].tolist()
                b += ids[linked].tolist()
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_of(batches, ["key", "low", "block"]):
            ids, of, few, left = (rows[c].to_numpy() for c in ("id", "component", "few", "left"))
            payload = kind(*(rows[c].to_pylist() for c in carried), *args)
            right = np.flatnonzero(~left)
            of, found = of.copy(), []
            for i in np.flatnonzero(left):
                others = right[(of[right] != of[i]) & (~few[right] | (ids[right] > ids[i]))]
                for j in payload.like(i, others) if len(others) else ():
                    if of[i] != of[j]:
                        found.append(sorted((int(ids[i]), int(ids[j]))))
                        of[of == of[j]] = of[i]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    size = F.sum("n_bytes").alias("size")
    first = [F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), "id"))["id"] for k in range(LEADERS)]
    sizes = members.groupBy("key").agg(size, F.array_distinct(F.array(*first)).alias("leaders")).where(F.col("size") > block)
    large = written(sizes.select("key", F.ceil(F.col("size") / block).cast("int").alias("blocks"), "leaders"), "large-groups")
    settled = large.isEmpty()
    if settled:
        dealt = members.select("key", F.lit(0).alias("block"), "id", *carried)
    else:
        cut = members.join(regrouped(large, "key"), "key", "left")
        own = F.coalesce(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.lit(0))
        everywhere = F.coalesce(F.array_contains("leaders", F.col("id")), F.lit(False))
        dealt = cut.select("key", F.explode(F.when(everywhere, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))).alias("block"), "id", *carried)
    links = written(dealt.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(giving_back(search), "a long, b long").distinct(), "links")
    if settled:
        return links, True
    known = connected_components(links).select(F.col("node").alias("id"), "component")
    placed = members.select("key", "id", "n_bytes").join(regrouped(large.select("key", "blocks"), "key"), "key").join(known, "id", "left").select("key", "id", "n_bytes", "blocks", F.coalesce("component", "id").alias("component"))
    placed = written(placed, "large-members")
    parts = placed.groupBy("key", "component").agg(size).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max_by("component", "size").alias("most"), (F.sum("size") - F.max("size")).alias("rest")).where("n > 1")
    lows = parts.select("key", "most", F.ceil(F.col("rest") / block).cast("int").alias("lows"))
    few = F.col("component") != F.col("most")
    still = placed.join(regrouped(lows, "key"), "key").select("key", "id", "component", "blocks", "lows", few.alias("few"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("lows")).cast("int").alias("low"))
    left = still.where("few").select("key", "id", "component", "few", F.lit(True).alias("left"), "low", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = still.select("key", "id", "component", "few", F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("lows") - 1)).alias("low"), "block")
    meet = left.unionByName(right).join(members.select("key", "id", *carried), ["key", "id"])
    more = written(meet.repartition("key", "low", "block").sortWithinPartitions("key", "low", "block").mapInArrow(giving_back(across), "a long, b long").distinct(), "links")
    return links.unionByName(more), False
