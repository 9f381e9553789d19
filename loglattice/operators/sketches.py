"""Approximate aggregates that can be stored and merged: distinct counts, quantiles, overlaps of sets.

A sketch of a group has a bounded size, however many rows the group has, and those of several groups, or days, merge to
that of all their rows. So they are made where the rows are, before the exchange, and a table of sketches answers for
any coarser grouping without the rows. Each kind knows its error.

Nulls count for nothing; a group of nulls only has none distinct and no quantile.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Distinct:
    """Different values, by HyperLogLog of 2 ** log_size slots."""

    column: str
    log_size: int = 12

    @property
    def error(self) -> float:
        """Relative standard error."""
        return 1.04 / 2 ** (self.log_size / 2)

    def made(self) -> Column:
        return F.hll_sketch_agg(F.col(self.column), F.lit(self.log_size))

    def merged(self, sketch: Column) -> Column:
        return F.hll_union_agg(sketch)

    def value(self, sketch: Column) -> Column:
        return F.hll_sketch_estimate(sketch)


@dataclass(frozen=True)
class Quantiles:
    """Quantiles of a number, by a KLL sketch of size k."""

    column: str
    at: tuple[float, ...] = (0.5, 0.9, 0.99)
    k: int = 200

    @property
    def error(self) -> float:
        """By how much a quantile's rank is wrong at most, as a share of all rows, at 99 % of times."""
        return 2.296 / self.k**0.9021

    def made(self) -> Column:
        return F.kll_sketch_agg_double(F.col(self.column).cast("double"), F.lit(self.k))

    def merged(self, sketch: Column) -> Column:
        return F.kll_merge_agg_double(sketch, F.lit(self.k))

    def value(self, sketch: Column) -> Column:
        return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(float(q)) for q in self.at])))


@dataclass(frozen=True)
class Members:
    """A set of values of which unions, intersections and differences can be counted, by a theta sketch of 2 ** log_size values."""

    column: str
    log_size: int = 12

    @property
    def error(self) -> float:
        """Relative standard error of a count; of an intersection or difference, relative to the union."""
        return 1 / 2 ** (self.log_size / 2)

    def made(self) -> Column:
        return F.theta_sketch_agg(F.col(self.column), F.lit(self.log_size))

    def merged(self, sketch: Column) -> Column:
        return F.theta_union_agg(sketch, F.lit(self.log_size))

    def value(self, sketch: Column) -> Column:
        return F.theta_sketch_estimate(sketch)


Sketch = Distinct | Quantiles | Members


def common_members(a: Column, b: Column) -> Column:
    """How many values two sets of Members have in common."""
    return F.theta_sketch_estimate(F.theta_intersection(a, b))


def members_without(a: Column, b: Column) -> Column:
    """How many values of a set of Members another one has not."""
    return F.theta_sketch_estimate(F.theta_difference(a, b))


def sketched(df: DataFrame, by: Sequence[str], **sketches: Sketch) -> DataFrame:
    """A row for each of by, with its number of rows, n, and a sketch of each name: a table to store and merge."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[s.made().alias(name) for name, s in sketches.items()])


def merged(table: DataFrame, by: Sequence[str], **sketches: Sketch) -> DataFrame:
    """A table of sketches for a coarser grouping, or for groups of which several rows were stored."""
    return table.groupBy(*by).agg(F.sum("n").alias("n"), *[s.merged(F.col(name)).alias(name) for name, s in sketches.items()])


def estimated(table: DataFrame, **sketches: Sketch) -> DataFrame:
    """table with what its sketches estimate in their place."""
    return table.withColumns({name: s.value(F.col(name)) for name, s in sketches.items()})
