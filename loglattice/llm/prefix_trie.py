"""A trie of rebuilt conversations by composable fingerprints.

A turn counts as its SHA-256, of which one half goes into fingerprints and the other one is kept with the reference
(conv_id, place) to check them. The fingerprint of a sequence is the sum of its turns' numbers times powers of a base,
modulo a prime of 127 bits, so that sequences form a monoid: fingerprints of a head and of what follows make that of
both. One sorted scan takes the products of all prefixes of the original conversations; where a conversation goes over
several ranges of the sort, those of its parts are put together. A rebuilt conversation is its base's head and its own
suffix, so that the fingerprints of its prefixes follow from products of the two, its base's and its own, without its texts.

Prefixes with equal fingerprints are a node. Whether they are equal is checked by references: all must have the same
parent, and turns of the same digest. Where fingerprints met by chance, all is done again with another base.

Each node belongs to its smallest member, so that a conversation owns a stretch of its path, up to its end. What
subtrees sum up is thus a sum over members of what they own, less what the smallest one owns above: no step goes level
by level. Ids of the members that end in a node are sorted over ranges and joined to long texts there; what is left
for one task, where a node has very many, is to hash those texts as a stream, which SHA-256 asks for.

Edge cases: null roles and texts are empty; turns of equal numbers go by role and text; conversations without an id are
left out; c % 5 has the sign of c; a base without turns gives no head; repeated turns count as often as they are there;
texts of any length are hashed whole; an empty table gives an empty result; extra columns have no effect.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, regrouped, written

# Conversations of a family, and by what the checksum's remainder gives a head's turns.
FAMILY, HEADS = 5, 9
PRIME = (1 << 127) - 1
#: Ids of a text that is hashed as a whole; depths of a block of running sums; characters that ranges of turns look at.
CHUNK, BLOCK, KEY = 65_536, 4096, 32
#: Bases that are tried.
TRIES = 5

TURN = "pid int, conv long, place long, g1 long, g2 long, p1 long, p2 long, s1 long, s2 long, n_bytes long, edge boolean"
INSTANCE = ("conv", "depth", "g1", "g2", "p1", "p2", "s1", "s2", "n_bytes", "size")
NODE = ("depth", "g1", "g2")


class Carry(NamedTuple):
    """What stands before the first conversation of a range, in ranges before: turns and their fingerprint."""

    conv: int
    turns: int
    value: int


def base_of(seed: int) -> int:
    return int.from_bytes(hashlib.sha256(f"base {seed}".encode()).digest()) % PRIME


def halves(numbers: list[int]) -> list[np.ndarray]:
    """Numbers under 2 ** 128 as two columns of signed 64 bits."""
    both = np.frombuffer(b"".join(x.to_bytes(16) for x in numbers), ">i8").astype(np.int64).reshape(-1, 2)
    return [both[:, 0], both[:, 1]]


def wholes(high: pa.Array, low: pa.Array) -> list[int]:
    return [(a & 0xFFFFFFFFFFFFFFFF) << 64 | (b & 0xFFFFFFFFFFFFFFFF) for a, b in zip(high.to_pylist(), low.to_pylist(), strict=True)]


def batch_of(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def digest_of(role: str, text: str) -> bytes:
    head = role.encode("utf-8", "surrogatepass")
    return hashlib.sha256(len(head).to_bytes(8) + head + text.encode("utf-8", "surrogatepass")).digest()


def scanned(conversations: DataFrame, seed: int) -> DataFrame:
    """TURN for each turn: its place and the fingerprints before (p) and after it (g), within its range of the sort.

    edge: the last row of a range's first and last conversations.
    """
    turns = conversations.where(conversations["conv_id"].isNotNull()).select(conversations["conv_id"].cast("long").alias("conv"), conversations["turn"].alias("turn"), F.coalesce(conversations["role"], F.lit("")).alias("role"), F.coalesce(conversations["text"], F.lit("")).alias("text"))
    base = base_of(seed)
    names = [c.split()[0] for c in TURN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        first, conv, rows = None, None, []
        place = value = 0
        power = 1

        def made(of: list[tuple]) -> pa.RecordBatch:
            convs, places, after, before, checks, sizes, edges = map(list, zip(*of, strict=True))
            return batch_of(names, [pa.array([pid] * len(of), pa.int32()), convs, places, *halves(after), *halves(before), *halves(checks), sizes, edges])

        for batch in batches:
            for c, role, text in zip(batch["conv"].to_pylist(), batch["role"].to_pylist(), batch["text"], strict=True):
                text = text.as_py()
                if c != conv:
                    if rows and conv == first:
                        rows[-1] = (*rows[-1][:-1], True)
                    first = c if first is None else first
                    conv, place, value, power = c, 0, 0, 1
                digest = digest_of(role, text)
                before, place = value, place + 1
                value, power = (value + int.from_bytes(digest[:16]) * power) % PRIME, power * base % PRIME
                rows.append((c, place, value, before, int.from_bytes(digest[16:]), len(text.encode("utf-8", "surrogatepass")), False))
            if len(rows) > 10_000:
                yield made(rows[:-1])
                rows = rows[-1:]
        if rows:
            rows[-1] = (*rows[-1][:-1], True)
            yield made(rows)

    start = [F.substring(c, 1, KEY) for c in ("role", "text")]
    ordered = turns.repartitionByRange("conv", F.col("turn").asc_nulls_first(), *start).sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    return written(ordered.mapInArrow(run, TURN), "trie-turns")


def carries(turns: DataFrame, base: int) -> dict[int, Carry]:
    """For each range whose first conversation began before it: what stands there. The driver gets two rows of a range at most."""
    found: dict[int, Carry] = {}
    so_far: Carry | None = None
    for pid, conv, place, g1, g2 in turns.where("edge").select("pid", "conv", "place", "g1", "g2").orderBy("pid", "conv").collect():
        value = (g1 & 0xFFFFFFFFFFFFFFFF) << 64 | (g2 & 0xFFFFFFFFFFFFFFFF)
        if so_far and so_far.conv == conv:
            found[pid] = so_far
            so_far = Carry(conv, so_far.turns + place, (so_far.value + pow(base, so_far.turns, PRIME) * value) % PRIME)
        else:
            so_far = Carry(conv, place, value)
    return found


def stitched(turns: DataFrame, base: int) -> DataFrame:
    """turns with places and fingerprints from the conversations' beginnings."""
    before = carries(turns, base)
    if not before:
        return turns
    powers = {pid: pow(base, c.turns, PRIME) for pid, c in before.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pids, convs, places = (batch[c].to_pylist() for c in ("pid", "conv", "place"))
            mine = [c if (c := before.get(p)) and c.conv == conv else None for p, conv in zip(pids, convs, strict=True)]
            if any(mine):
                after, prior = wholes(batch["g1"], batch["g2"]), wholes(batch["p1"], batch["p2"])
                for i, c in enumerate(mine):
                    if c:
                        places[i] += c.turns
                        after[i], prior[i] = (c.value + powers[pids[i]] * after[i]) % PRIME, (c.value + powers[pids[i]] * prior[i]) % PRIME
                batch = batch_of(batch.schema.names, [batch["pid"], batch["conv"], places, *halves(after), *halves(prior), *(batch[c] for c in ("s1", "s2", "n_bytes", "edge"))])
            yield batch

    return turns.mapInArrow(run, TURN)


def head_turns(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("long")


def facts_of(turns: DataFrame) -> DataFrame:
    """For each conversation: h, the turns of its base's head that are there (head), the length when rebuilt (size), and
    the fingerprints of that head (b1, b2) and of its own first h turns (o1, o2); suffix: whether it has more."""
    heads = F.sort_array(F.collect_list(F.when(F.col("place") < HEADS, F.struct("place", "g1", "g2", "p1", "p2", "s1", "s2", "n_bytes"))))
    own = written(turns.groupBy("conv").agg(F.max("place").alias("n"), heads.alias("heads")), "trie-heads")
    bases = own.where(F.col("conv") % FAMILY == 0).select(F.col("conv").alias("base"), F.col("heads").alias("base_heads"))
    both = own.withColumn("h", head_turns(F.col("conv"))).join(bases, F.col("conv") - F.col("conv") % FAMILY == F.col("base"), "left")
    at = lambda some, i, name: F.coalesce(F.get(some, (i - 1).cast("int"))[name], F.lit(0).cast("long"))
    both = both.withColumn("head", F.slice(F.coalesce("base_heads", F.slice("heads", 1, 0)), F.lit(1), F.col("h").cast("int"))).withColumn("k", F.size("head").cast("long"))
    both = both.withColumns({"b1": at(F.col("head"), F.col("k"), "g1"), "b2": at(F.col("head"), F.col("k"), "g2"), "o1": at(F.col("heads"), F.col("h"), "g1"), "o2": at(F.col("heads"), F.col("h"), "g2")})
    return both.select("conv", "h", "k", "head", "b1", "b2", "o1", "o2", (F.col("n") > F.col("h")).alias("suffix"), (F.col("k") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("size"))


def instances_of(turns: DataFrame, facts: DataFrame, base: int) -> DataFrame:
    """INSTANCE for each prefix of each rebuilt conversation but the empty one."""
    heads = facts.select("conv", "size", F.explode("head").alias("x")).select("conv", F.col("x.place").alias("depth"), *[F.col(f"x.{c}").alias(c) for c in INSTANCE[2:-1]], "size")
    of = facts.where("suffix").select(F.col("conv").alias("c"), "h", "k", "b1", "b2", "o1", "o2", "size")
    own = turns.join(of, (F.col("conv") == F.col("c")) & (F.col("place") > F.col("h"))).drop("pid", "c", "edge")
    back = [pow(base, -i, PRIME) for i in range(HEADS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, k, places = (batch[c].to_pylist() for c in ("h", "k", "place"))
            after, prior, heads, mine = (wholes(batch[f"{c}1"], batch[f"{c}2"]) for c in "gpbo")
            made = [[(b + (x - o) * back[i - j]) % PRIME for x, b, o, i, j in zip(some, heads, mine, h, k, strict=True)] for some in (after, prior)]
            depths = [j + p - i for i, j, p in zip(h, k, places, strict=True)]
            if depths:
                yield batch_of(list(INSTANCE), [batch["conv"], depths, *halves(made[0]), *halves(made[1]), *(batch[c] for c in ("s1", "s2", "n_bytes", "size"))])

    return heads.unionByName(own.mapInArrow(run, ", ".join(f"{c} long" for c in INSTANCE)))


def nodes_of(instances: DataFrame) -> DataFrame:
    """NODE, parent (p1, p2), n_bytes of the last text, n_convs, conv_id, longest, and whether all members agree."""
    fixed = ("p1", "p2", "s1", "s2", "n_bytes")
    found = instances.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"), F.max("size").alias("longest"), *[F.min(c).alias(c) for c in fixed], *[F.max(c).alias(f"{c}_too") for c in fixed])
    agree = F.lit(True)
    for c in fixed:
        agree &= F.col(c) == F.col(f"{c}_too")
    return found.select(*NODE, "p1", "p2", "n_bytes", "n_convs", "conv_id", "longest", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"), agree.alias("agree"))


def digests_of(ends: DataFrame) -> DataFrame:
    """NODE, ends_sha256 of the ids (conv) of each node in ascending order, joined by commas."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, out = None, [], []

        def flush() -> None:
            if ids:
                out.append((*node, ids[0], ",".join(map(str, ids)).encode()))
                ids.clear()

        for batch in batches:
            for d, g1, g2, conv in zip(*(batch[c].to_pylist() for c in (*NODE, "conv")), strict=True):
                if (d, g1, g2) != node or len(ids) == CHUNK:
                    flush()
                    node = (d, g1, g2)
                ids.append(conv)
            if len(out) > 1000:
                yield batch_of([*NODE, "first", "ids"], list(zip(*out, strict=True)))
                out.clear()
        flush()
        if out:
            yield batch_of([*NODE, "first", "ids"], list(zip(*out, strict=True)))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, out = None, None, []
        for batch in batches:
            for d, g1, g2, ids in zip(*(batch[c].to_pylist() for c in NODE), batch["ids"], strict=True):
                if (d, g1, g2) == node:
                    sha.update(b",")
                else:
                    if node:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (d, g1, g2), hashlib.sha256()
                sha.update(ids.as_py())
            if len(out) > 10_000:
                yield batch_of([*NODE, "ends_sha256"], list(zip(*out, strict=True)))
                out = []
        if node:
            yield batch_of([*NODE, "ends_sha256"], list(zip(*[*out, (*node, sha.hexdigest())], strict=True)))

    joined = ends.repartitionByRange(*NODE, "conv").sortWithinPartitions(*NODE, "conv").mapInArrow(join, "depth long, g1 long, g2 long, first long, ids binary")
    return written(joined.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(hashed, "depth long, g1 long, g2 long, ends_sha256 string"), "trie-ends")


def owned_above(nodes: DataFrame) -> DataFrame:
    """nodes with `above`, what their smallest member owns of `saved` on its path above: running sums in blocks of depths."""
    placed = nodes.withColumn("block", F.floor(F.col("depth") / BLOCK))
    sums = placed.groupBy("conv_id", "block").agg(F.sum("saved").alias("of_block"))
    before = sums.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("of_block").over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("saved").over(Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    both = placed.withColumn("inside", inside).join(before, (F.col("conv_id") == F.col("c")) & (F.col("block") == F.col("b")))
    return both.withColumn("above", F.col("before") + F.col("inside")).drop("c", "b", "block", "before", "inside")


def _on_node(df: DataFrame, *more: str, depth: Column | None = None, g: str = "g") -> DataFrame:
    """df's columns `more`, with its node's key as d, x1, x2, for a join."""
    return df.select((F.col("depth") if depth is None else depth).alias("d"), F.col(f"{g}1").alias("x1"), F.col(f"{g}2").alias("x2"), *more)


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for each node."""
    spark = conversations.sparkSession
    for seed in range(TRIES):
        turns = scanned(conversations, seed)
        whole = stitched(turns, base_of(seed))
        facts = written(facts_of(whole), "trie-facts")
        instances = written(instances_of(whole, facts, base_of(seed)), "trie-prefixes")
        nodes = written(nodes_of(instances), "trie-nodes")
        discard(turns)
        if nodes.where("not agree").isEmpty():
            break
        for made in (facts, instances, nodes):
            discard(made)
    else:
        raise RuntimeError(f"fingerprints met by chance with each of {TRIES} bases")

    same = lambda d, x1, x2: (F.col("depth") == F.col(d)) & (F.col("g1") == F.col(x1)) & (F.col("g2") == F.col(x2))
    owners = written(nodes.groupBy("conv_id").agg(F.sum("saved").alias("chain"), F.count_if(F.col("longest") == F.col("depth")).alias("leaf")), "trie-owners")
    of = regrouped(owners.where("chain > 0 or leaf > 0"), "conv_id").withColumnRenamed("conv_id", "c")
    sums = instances.join(of, F.col("conv") == F.col("c")).groupBy(*NODE).agg(F.sum("chain").alias("chains"), F.sum("leaf").alias("n_leaves"))
    children = nodes.groupBy((F.col("depth") - 1).alias("d"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count(F.lit(1)).alias("n_children"))
    ended = instances.where("depth = size").select(*NODE, "conv").unionByName(facts.where("size = 0").select(*[F.lit(0).cast("long").alias(c) for c in NODE], "conv"))
    digests = digests_of(ended)
    none = hashlib.sha256(b"").hexdigest()
    whole = facts.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("c")).first()
    totals = owners.agg(F.sum("chain"), F.sum("leaf")).first()
    top = digests.where("depth = 0").first()
    first = children.where("d = 0").agg(F.sum("n_children")).first()[0] or 0
    parents = regrouped(_on_node(nodes, F.col("conv_id").alias("parent_conv_id")), "d", "x1", "x2")
    made = owned_above(nodes)
    made = made.join(_on_node(sums, "chains", "n_leaves"), same("d", "x1", "x2"), "left").drop("d", "x1", "x2")
    made = made.join(children, same("d", "x1", "x2"), "left").drop("d", "x1", "x2")
    made = made.join(_on_node(digests, "ends_sha256"), same("d", "x1", "x2"), "left").drop("d", "x1", "x2")
    made = made.join(parents, (F.col("depth") - 1 == F.col("d")) & (F.col("p1") == F.col("x1")) & (F.col("p2") == F.col("x2")), "left").drop("d", "x1", "x2")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    made = made.select("conv_id", "depth", F.when(F.col("depth") == 1, F.lit(whole["c"])).otherwise(F.col("parent_conv_id")).cast("long").alias("parent_conv_id"), "n_convs", number("n_children"), number("n_leaves"), (F.coalesce(F.col("chains"), F.lit(0)) - F.col("above")).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
    root = [(whole["c"], 0, None, whole["n"], first, totals[1] or 1, totals[0] or 0, top["ends_sha256"] if top else none)] if whole["n"] else []
    result = written(made.unionByName(spark.createDataFrame(root, made.schema)), "trie")
    for table in (facts, instances, nodes, owners, digests):
        discard(table)
    return result
