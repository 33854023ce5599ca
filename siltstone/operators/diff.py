"""Differences between two copies of data, field by field."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.shared import materialize


def _default(kind: T.DataType) -> Column | None:
    """A value that stands for null in a key of this type, beside a flag; None for types that have no plain one."""
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.BinaryType):
        return F.lit("").cast("binary")
    if isinstance(kind, T.NumericType | T.BooleanType):
        return F.lit(0).cast(kind)
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        return F.lit("1970-01-01").cast(kind)
    return None


def _rows(df: DataFrame, key: str, fields: Sequence[str], normalise: Callable[[str, Column], Column]) -> DataFrame:
    return df.select(F.col(key).alias("k"), *(normalise(f, F.col(f)).alias(f"f{i}") for i, f in enumerate(fields)))


def _print(n: int) -> Column:
    return F.xxhash64(F.struct(*(F.struct(F.col(f"f{i}").isNull(), F.col(f"f{i}")) for i in range(n))))


def _side(rows: DataFrame, n: int) -> DataFrame:
    """One row per key: of each field its least and greatest value and whether it holds a null; the least and greatest fingerprint of its rows.

    None of these is changed by repeated rows, so one aggregation does, combined before the one exchange by key
    that the join needs too: null is a plain value with a flag in it.
    """
    names = [f"f{i}" for i in range(n)]
    states = [F.struct(F.min(f).alias("least"), F.max(f).alias("most"), F.max(F.col(f).isNull()).alias("gap")).alias(f) for f in names]
    plain = _default(rows.schema["k"].dataType)
    keys = [F.col("k").alias("key"), F.lit(False).alias("gap")] if plain is None else [F.coalesce("k", plain).alias("key"), F.col("k").isNull().alias("gap")]
    return rows.groupBy(*keys).agg(*states, F.min(_print(n)).alias("p0"), F.max(_print(n)).alias("p1"), F.lit(True).alias("here"))


def differences(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str], normalise: Callable[[str, Column], Column] = lambda _, c: c) -> DataFrame:
    """(key, side, differences) of the keys on which the copies disagree.

    side is 'only_a', 'only_b' or null; differences an array of (field, left, right) with the
    values as strings. Null equals null and nothing else, as key and as value; the empty string is
    a value. Repeated rows count once. Where a key has several different rows on a side, a field
    differs unless both sides have the same least and greatest value and null for it; rows that
    differ in another way show as field '*'. Extra columns are ignored, whatever their names.

    Each side is reduced to a row per key first, with map-side combination, so a hot key is one
    row in the null-safe full outer join. What that finds is stored; keys with several rows on
    both sides that it can't tell apart are then compared row by row, by sets of their rows.
    """
    n = len(fields)
    rows = [_rows(df, key, fields, normalise) for df in (left, right)]
    a, b = (_side(r, n).alias(name) for r, name in zip(rows, "ab"))
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.gap") == F.col("b.gap"))
    if _default(rows[0].schema["k"].dataType) is None:
        same = F.col("a.key").eqNullSafe(F.col("b.key"))
    joined = a.join(b, same, "full")
    both = F.col("a.here") & F.col("b.here")
    entry = lambda name, x, y: F.struct(F.lit(name).alias("field"), x.cast("string").alias("left"), y.cast("string").alias("right"))
    unequal = [F.when(~F.col(f"a.f{i}").eqNullSafe(F.col(f"b.f{i}")), entry(f, F.col(f"a.f{i}.least"), F.col(f"b.f{i}.least"))) for i, f in enumerate(fields)]
    listed = F.array_compact(F.array(*unequal))
    other = (F.col("a.p0") != F.col("b.p0")) | (F.col("a.p1") != F.col("b.p1"))
    rest = F.array(entry("*", F.lit(None), F.lit(None)))
    part = F.when(F.col("a.here"), F.struct("a.key", "a.gap")).otherwise(F.struct("b.key", "b.gap"))
    found = joined.select(
        F.when(~part["gap"], part["key"]).alias("k"),
        F.when(F.col("b.here").isNull(), "only_a").when(F.col("a.here").isNull(), "only_b").alias("side"),
        F.when(both, F.when(other & (F.size(listed) == 0), rest).otherwise(listed)).alias("differences"),
        (both & (F.size(listed) == 0) & ~other & (F.col("a.p0") != F.col("a.p1"))).alias("open"),
    ).where("side is not null or size(differences) > 0 or open")
    found = materialize(found, "differences")
    out = found.where("not coalesce(open, false)").select(F.col("k").alias(key), "side", "differences")
    unsure = found.where("open").select(F.col("k").alias("u"))
    if unsure.isEmpty():
        return out
    sets = [_set(r, unsure, n).alias(name) for r, name in zip(rows, "ab")]
    unlike = sets[0].join(sets[1], F.col("a.k").eqNullSafe(F.col("b.k"))).where("a.print <> b.print or a.n <> b.n")
    return out.unionByName(unlike.select(F.col("a.k").alias(key), F.lit(None).cast("string").alias("side"), rest.alias("differences")))


def _set(rows: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """(k, n, print): number and fingerprint of the different rows of each of the keys, in two aggregations, so that the rows of a hot one are spread."""
    own = rows.join(keys, F.col("k").eqNullSafe(F.col("u")), "left_semi")
    return own.select("k", _print(n).alias("p")).distinct().groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("p").alias("print"))


def difference_fields(found: DataFrame, key: str) -> DataFrame:
    """(key, field): a row for each one-sided key and for each differing field."""
    names = F.when(F.col("side").isNotNull(), F.array("side")).otherwise(F.col("differences.field"))
    return found.select(key, F.explode(names).alias("field"))
