"""Joins: which physical one runs is left to Catalyst and AQE, except where size must be proven first."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.shared import materialize, unused

#: Most rows of a side that is copied to every executor.
SMALL = 100_000

#: Least rows of a key that is salted, and most keys that are; any other key has less than a thousandth of the rows.
HOT, HOTTEST = 100_000, 1_000


def is_small(df: DataFrame, most: int = SMALL) -> bool:
    """Whether df has at most ``most`` rows; reads no further than that."""
    return df.limit(most + 1).count() <= most


def mapped(facts: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner", most: int = SMALL) -> DataFrame:
    """Join with a lookup table: broadcast if its size is checked to be small, else salted against hot keys."""
    if is_small(lookup, most):
        return facts.join(F.broadcast(lookup), list(on), how)
    return salted(facts, lookup, on, how)


def salted(facts: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner", salts: int = 16, hot: int = HOT) -> DataFrame:
    """Equi-join ('inner' or 'left') whose keys may be hot in ``facts``: a key of ``hot`` rows or more is spread over ``salts`` tasks, its rows of the lookup repeated as often.

    Hot keys are counted first and stored, so that both sides salt the same ones; if there are none, this is a plain join.
    """
    on = list(on)
    salt, n = (unused(x, facts, lookup) for x in ("salt", "n"))
    most = facts.groupBy(*on).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) >= hot).orderBy(F.col(n).desc()).limit(HOTTEST)
    found = materialize(most, "hot")
    if is_small(found, 0):
        return facts.join(lookup, on, how)
    is_hot, found = F.col(n).isNotNull(), F.broadcast(found)
    rest = [c for c in facts.columns if c not in on] or on
    gap = reduce(or_, (F.col(c).isNull() for c in on))  # meets nothing, but may be as frequent
    left = facts.join(found, on, "left").withColumn(salt, F.when(is_hot | gap, F.pmod(F.xxhash64(*rest, *on), F.lit(salts))).otherwise(F.lit(0).cast("bigint"))).drop(n)
    each = F.when(is_hot, F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    right = lookup.join(found, on, "left").withColumn(salt, F.explode(each)).drop(n)
    # Spark's estimate of the repeated side knows nothing of the repetition, so it must not decide on a broadcast
    return left.join(right.hint("merge"), [*on, salt], how).drop(salt)


def not_in(df: DataFrame, c: str, other: DataFrame, value: str) -> DataFrame:
    """``c NOT IN (other.value)``: nothing if a value is null; rows of null c only if there are no values.

    A plain anti-join, so that neither side has to be copied, and one row of counts.
    """
    v, n, gaps = (unused(x, df) for x in ("v", "n", "gaps"))
    values = other.select(F.col(value).alias(v))
    state = values.agg(F.count(F.lit(1)).alias(n), F.count_if(F.col(v).isNull()).alias(gaps))
    kept = df.join(values, F.col(c) == F.col(v), "left_anti")
    return kept.join(F.broadcast(state), (F.col(n) == 0) | ((F.col(gaps) == 0) & F.col(c).isNotNull()), "left_semi")


def cross(a: DataFrame, b: DataFrame, most: int = 1_000_000) -> DataFrame:
    """All pairs of two tables whose product is proven to be small; refused otherwise."""
    n, m = a.limit(most + 1).count(), b.limit(most + 1).count()
    if n * m > most:
        raise ValueError(f"a cross join of {n} by {m} rows; at most {most} pairs are made")
    return a.join(F.broadcast(b), F.lit(True))


def count_less(left: DataFrame, x: str, right: DataFrame, y: str, width: float) -> DataFrame:
    """For each row of ``left`` the number n_less of rows of ``right`` with y < x: a theta join reduced to counts.

    Rows meet in buckets of ``width``: counts of whole buckets below come from running sums over the
    buckets, the rest from ranks within a bucket, so no pairs are made. Null x counts 0.
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(width)).cast("bigint")
    mark = unused("mark", left)
    own = left.withColumn(mark, F.col(x).cast("double"))
    below = right.select(F.col(y).cast("double").alias("x")).where("x is not null").withColumn("b", bucket("x"))
    wanted = own.select(F.col(mark).alias("x")).where("x is not null").distinct().withColumn("b", bucket("x"))
    # values with their numbers of rows, those asked for with none
    counted = below.select("b", "x", F.lit(1).cast("bigint").alias("k")).unionByName(wanted.select("b", "x", F.lit(0).cast("bigint").alias("k"))).groupBy("b", "x").agg(F.sum("k").alias("k"))
    first = F.sum("k").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1))  # a row per bucket
    buckets = counted.groupBy("b").agg(F.sum("k").alias("k")).select("b", F.coalesce(first, F.lit(0)).alias("base"))
    inside = F.sum("k").over(Window.partitionBy("b").orderBy("x").rowsBetween(Window.unboundedPreceding, -1))
    found = counted.withColumn("inside", F.coalesce(inside, F.lit(0))).join(buckets, "b").select(F.col("x").alias(unused("found", own)), (F.col("inside") + F.col("base")).alias("n_less"))
    joined = own.join(found, F.col(mark) == F.col(found.columns[0]), "left")
    return joined.withColumn("n_less", F.coalesce("n_less", F.lit(0))).drop(mark, found.columns[0])


def range_join(points: DataFrame, x: str, ranges: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= x < high: an equi-join on buckets of ``width``, as wide as ranges usually are."""
    bucket = lambda c: F.floor(c / F.lit(width)).cast("bigint")
    b = unused("bucket", points, ranges)
    spread = ranges.where(F.col(low) < F.col(high)).withColumn(b, F.explode(F.sequence(bucket(F.col(low)), bucket(F.col(high)))))
    return points.withColumn(b, bucket(F.col(x))).join(spread, b).where((F.col(low) <= F.col(x)) & (F.col(x) < F.col(high))).drop(b)


def anti_by_null(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """LEFT JOIN … WHERE right key IS NULL."""
    return left.join(right, condition, "left_anti")


def union_tables(*tables: DataFrame) -> DataFrame:
    """Several tables of one schema as one; refused where names or types differ."""
    first = [(f.name, f.dataType) for f in tables[0].schema]
    for t in tables[1:]:
        if [(f.name, f.dataType) for f in t.schema] != first:
            raise ValueError("the tables differ in their columns")
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def union_wide(a: DataFrame, b: DataFrame, distinct: bool = False) -> DataFrame:
    """UNION by position; a column that is text on one side becomes text on both."""
    texts = ["string" in (x.dataType.simpleString(), y.dataType.simpleString()) for x, y in zip(a.schema, b.schema)]
    cast = lambda df: df.select(*(F.col(c).cast("string").alias(n) if t else F.col(c).alias(n) for c, n, t in zip(df.columns, a.columns, texts)))
    both = cast(a).union(cast(b))
    return both.distinct() if distinct else both
