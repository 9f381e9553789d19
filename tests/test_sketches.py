"""Sketches keep their stated errors, merge as their rows would, and stay small."""

from pyspark.sql import functions as F

from loglattice.operators import sketches as sk

OF = {"users": sk.Distinct("user"), "members": sk.Members("user"), "v": sk.Quantiles("v", (0.1, 0.5, 0.9))}


def rows(spark, n=60_000):
    """Half of the rows in one group."""
    return spark.range(n).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 7).alias("g"), (F.col("id") % 3).alias("day"), (F.col("id") * 7919 % 20_011).alias("user"), F.pmod(F.xxhash64("id"), F.lit(100_000)).cast("double").alias("v"))


def test_errors_and_merges(spark):
    df = rows(spark)
    daily = sk.sketched(df, ["g", "day"], **OF)
    for by in (["g"], []):
        found = {r["g"] if by else None: r for r in sk.estimated(sk.merged(daily, by, **OF), **OF).collect()}
        for key in found:
            mine = df.where(F.col("g") == key) if by else df
            n = mine.select("user").distinct().count()
            assert abs(found[key].users - n) <= 3 * OF["users"].error * n and abs(found[key].members - n) <= 3 * OF["members"].error * n
            assert found[key].n == mine.count()
            for q, v in zip(OF["v"].at, found[key].v, strict=True):
                assert abs(mine.where(F.col("v") <= v).count() / mine.count() - q) <= OF["v"].error
    once, twice = (sk.estimated(sk.merged(t, ["g"], **OF), **OF).select("g", "users", "members").collect() for t in (daily, daily.union(daily)))
    assert sorted(map(tuple, once)) == sorted(map(tuple, twice))  # sets don't grow by what they have


def test_sketches_are_small_and_made_before_the_exchange(spark):
    small, large = (sk.sketched(rows(spark, n), [], **OF).select(*[F.octet_length(c).alias(c) for c in OF]).first() for n in (60_000, 240_000))
    assert all(large[c] <= 1.2 * small[c] + 100 and large[c] < 50_000 for c in OF)
    plan = sk.sketched(rows(spark), ["g"], **OF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_hll_sketch_agg") == 1 or "partial_hllsketchagg" in plan.lower()


def test_sets(spark):
    a, b = spark.range(0, 3000).select(F.col("id").alias("user")), spark.range(1000, 5000).select(F.col("id").alias("user"))
    m = sk.Members("user")
    both = sk.sketched(a, [], a=m).select("a").withColumn("k", F.lit(1)).join(sk.sketched(b, [], b=m).select("b").withColumn("k", F.lit(1)), "k")
    common, rest = both.select(sk.common_members(F.col("a"), F.col("b")), sk.members_without(F.col("a"), F.col("b"))).first()
    assert abs(common - 2000) <= 3 * m.error * 5000 and abs(rest - 1000) <= 3 * m.error * 5000


def test_nulls_and_nothing(spark):
    none = spark.createDataFrame([(1, None, None), (1, None, None)], "g long, user long, v double")
    got = sk.estimated(sk.sketched(none, ["g"], **OF), **OF).first()
    assert (got.n, got.users, got.members, got.v) == (2, 0, 0, None)
    assert sk.estimated(sk.sketched(none.where("false"), ["g"], **OF), **OF).count() == 0
