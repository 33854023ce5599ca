"""Statements that change rows, as functions from tables to tables; writing the result is an atomic overwrite."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _same(keys: Sequence[str], a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys))


def last_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of each key the row with the greatest order, combined before the shuffle; of equal ones the greatest row."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__r"))
    return best.select(*(F.col(c) if c in keys else F.col(f"__r.{c}") for c in rows.columns))


def replace_into(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """REPLACE INTO: rows take the place of those with their key; of several rows with one key the last of ``order`` counts."""
    new = last_rows(rows, keys, order)
    return target.alias("t").join(new.alias("n"), _same(keys, "t", "n"), "left_anti").unionByName(new.select(*target.columns))


def upsert(target: DataFrame, rows: DataFrame, keys: Sequence[str], update: Mapping[str, Column]) -> DataFrame:
    """INSERT … ON DUPLICATE KEY UPDATE: expressions over t.column and n.column; keys of ``rows`` must be unique."""
    both = target.alias("t").withColumn("__t", F.lit(True)).alias("t").join(rows.withColumn("__n", F.lit(True)).alias("n"), _same(keys, "t", "n"), "full")
    old, new = F.col("t.__t").isNotNull(), F.col("n.__n").isNotNull()
    value = lambda c: F.when(old & new, update[c]).when(old, F.col(f"t.{c}")).otherwise(F.col(f"n.{c}")) if c in update else F.when(old, F.col(f"t.{c}")).otherwise(F.col(f"n.{c}"))
    return both.select(*(value(c).alias(c) for c in target.columns))


def update(target: DataFrame, where: Column, assign: Mapping[str, Column]) -> DataFrame:
    """UPDATE: rows for which ``where`` isn't true stay as they are."""
    hit = F.coalesce(where, F.lit(False))
    return target.select(*(F.when(hit, assign[c]).otherwise(F.col(c)).alias(c) if c in assign else F.col(c) for c in target.columns))


def update_from(target: DataFrame, other: DataFrame, keys: Sequence[str], assign: Mapping[str, Column]) -> DataFrame:
    """Multi-table UPDATE: rows with a partner in ``other`` (unique keys) get expressions over t.column and o.column."""
    both = target.alias("t").join(other.withColumn("__o", F.lit(True)).alias("o"), _same(keys, "t", "o"), "left")
    return both.select(*(F.when(F.col("o.__o").isNotNull(), assign[c]).otherwise(F.col(f"t.{c}")).alias(c) if c in assign else F.col(f"t.{c}") for c in target.columns))


def delete(target: DataFrame, where: Column) -> DataFrame:
    """DELETE: rows for which ``where`` is false or unknown stay."""
    return target.where(~F.coalesce(where, F.lit(False)))


def delete_using(target: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Multi-table DELETE: rows with a partner in ``other`` go."""
    return target.alias("t").join(other.alias("o"), _same(keys, "t", "o"), "left_anti")


def delete_limit(target: DataFrame, where: Column, order: Sequence[Column], n: int, key: Sequence[str]) -> DataFrame:
    """DELETE … ORDER BY … LIMIT n: the first n of the rows hit go; ``key`` is unique."""
    gone = target.where(where).orderBy(*order).limit(n).select(*key)
    return delete_using(target, gone, key)


def truncate(target: DataFrame) -> DataFrame:
    return target.where(F.lit(False))


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """CREATE TABLE … SELECT ('overwrite') or INSERT … SELECT ('append'), as Parquet; returns the table."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.parquet(path)
