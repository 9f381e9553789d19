"""URL rules by a sort-merge range join.

A host's labels, reversed, make a key under which a domain and its subdomains are one interval. Pages and rules
are dealt to slots of the key's range, a rule to every slot that its interval meets; each slot is sorted and swept
once with a stack of the hosts that are open. Paths are intervals, too: a host's rules come sorted by path, each
knows the one that it is nested in, and a page goes from the last rule at or before its path outwards to the first
that it starts with. A page thus costs a binary search and the rules nested around it for each open host, however
many rules a host has. Rules may be many: no side is broadcast, and what the driver sees is SAMPLE keys, from which it takes the slots' bounds. A key that fills
several slots is dealt over all of them, so that one host, or one url, may hold any share of the pages.

Edge cases: a null url, or one without `://`, has an empty host and path and fits no rule; rules with a null or
empty host are left out, a null path counts as empty; of two fitting rules of equal length, that of the longer host
wins, and of rules for the same host and path the first verdict in order; repeated pages each get a row; an empty table gives an empty result; extra columns have no effect.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import uniform

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys from which the bounds come, about.
SAMPLE = 20_000


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def key_of(host: Column) -> Column:
    """a.example.com as `com.example.a.`: what starts with `com.example.` is example.com or under it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


class Nested:
    """A host's rules, added in order of their paths."""

    def __init__(self, key: str):
        self.key = key
        self.paths: list[str] = []
        self.rules: list[tuple[str, str]] = []
        self.outer: list[int] = []  # the place of the rule that each is nested in, or -1

    def add(self, path: str, rule: str, verdict: str) -> None:
        if not self.paths or self.paths[-1] != path:
            self.outer.append(self._around(path, len(self.paths) - 1))
            self.paths.append(path)
            self.rules.append((rule, verdict))

    def longest(self, path: str) -> tuple[str, str] | None:
        """The rule of the longest path that path starts with: it is around whatever stands between it and path."""
        at = self._around(path, bisect_right(self.paths, path) - 1)
        return self.rules[at] if at >= 0 else None

    def _around(self, path: str, at: int) -> int:
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.outer[at]
        return at


def bounds_of(pages: DataFrame, slots: int) -> list[str]:
    """Keys that cut the pages into about equal slots, from a sample drawn by hash: SAMPLE keys, however many pages there are."""
    share = SAMPLE / max(SAMPLE, pages.count())
    keys = sorted(r.key for r in pages.where(uniform("key", "path", "page_id") < share).select("key").collect())
    return [keys[len(keys) * i // slots] for i in range(1, slots)] if keys else []


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for each of pages (page_id, url), by rules (host, path, verdict); default where none fits."""
    spark = pages.sparkSession
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = pages.select(pages["page_id"].cast("long").alias("page_id"), host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path"))
    parts = parts.withColumn("key", key_of(F.col("host")))
    bounds = bounds_of(parts, slots)

    def page_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, h in zip(batch["key"].to_pylist(), batch["h"].to_pylist(), strict=True):
                low, high = bisect_left(bounds, key), bisect_right(bounds, key)
                out.append(low + h % (high - low + 1))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32()), *(batch[c] for c in ("key", "page_id", "host", "path"))], names=["slot", "key", "page_id", "host", "path"])

    def rule_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                low, high = bisect_left(bounds, row["key"]), bisect_left(bounds, row["key"][:-1] + "/")
                for at in range(low, high + 1, 10_000):
                    n = min(10_000, high + 1 - at)
                    yield pa.RecordBatch.from_arrays([pa.array(range(at, at + n), pa.int32()), *(pa.array([row[c]] * n, pa.string()) for c in ("key", "host", "path", "verdict"))], names=["slot", "key", "host", "path", "verdict"])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, open_hosts = None, []  # each key a prefix of the next one's
        for batch in batches:
            out = []
            for s, key, is_page, page_id, host, path, verdict in zip(*(batch[c].to_pylist() for c in ("slot", "key", "is_page", "page_id", "host", "path", "verdict")), strict=True):
                if s != slot:
                    slot, open_hosts = s, []
                while open_hosts and not key.startswith(open_hosts[-1].key):
                    open_hosts.pop()
                if not is_page:
                    if not open_hosts or open_hosts[-1].key != key:
                        open_hosts.append(Nested(key))
                    open_hosts[-1].add(path, host + path, verdict)
                    continue
                fitting = [x for x in (nested.longest(path) for nested in reversed(open_hosts)) if x]
                best = max(fitting, key=lambda x: len(x[0]), default=(None, default))  # the first of the longest
                out.append((page_id, host, path, *best))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], names=["page_id", "host", "path", "rule", "verdict"])

    dealt = parts.withColumn("h", F.abs(F.hash("page_id", "path").cast("long"))).mapInArrow(page_slots, "slot int, key string, page_id long, host string, path string")
    known = rules.where(F.coalesce(rules["host"], F.lit("")) != "").select(F.translate(rules["host"], UPPER, LOWER).alias("host"), F.coalesce(rules["path"], F.lit("")).alias("path"), rules["verdict"])
    copied = known.withColumn("key", key_of(F.col("host"))).mapInArrow(rule_slots, "slot int, key string, host string, path string, verdict string")
    rows = dealt.withColumns({"is_page": F.lit(True), "verdict": F.lit(None).cast("string")}).unionByName(copied.withColumns({"is_page": F.lit(False), "page_id": F.lit(None).cast("long")}))
    placed = rows.repartitionById(slots, F.col("slot")).sortWithinPartitions("slot", "key", "is_page", "path", "verdict")
    return placed.mapInArrow(sweep, "page_id long, host string, path string, rule string, verdict string")
