"""Sorting, limits and range splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top(df: DataFrame, n: int, *order: Column, offset: int = 0) -> DataFrame:
    """ORDER BY … LIMIT offset, n: a top-k per partition merged, without a full sort."""
    return df.orderBy(*order).offset(offset).limit(n) if offset else df.orderBy(*order).limit(n)


def found_rows(df: DataFrame) -> DataFrame:
    """FOUND_ROWS(): the number of rows without the limit."""
    return df.agg(F.count(F.lit(1)).alias("found_rows"))


def range_split(df: DataFrame, key: str, parts: int, accuracy: int = 10_000) -> list:
    """Up to ``parts - 1`` ascending split keys at quantiles; sketches are merged, rows stay where they are."""
    cuts = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], accuracy)).first()[0] if parts > 1 else None
    return sorted(set(cuts or []))


def split_of(key: Column, cuts: list) -> Column:
    """Number of the range that a key falls in: the split keys below it."""
    return sum((F.when(key > c, 1).otherwise(0) for c in cuts), F.lit(0))


def sorted_load(df: DataFrame, path: str, *keys: str, files: int | None = None) -> None:
    """Write df sorted by ``keys`` in files of adjoining ranges, so that footers tell which files a range query needs."""
    ranged = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def order_violations(df: DataFrame, key: str) -> DataFrame:
    """(path, first, last) of the files of a sorted table that overlap the next one: the check of a sorted load."""
    from pyspark.sql.window import Window

    files = df.select(F.input_file_name().alias("path"), F.col(key).alias("k")).groupBy("path").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    # one row per file
    return files.withColumn("next", F.lead("first").over(Window.orderBy("first", "last"))).where("last > next").select("path", "first", "last")
