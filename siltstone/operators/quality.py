"""Column-level data quality from statistics of column chunks.

A chunk is a part of one column with reported statistics: a pack of the reference's column
store, or a column of a row group in a Parquet footer. Statistics that can't be true are
reported; profiles and comparisons of loads use the valid ones only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Fixed values of the pack format.
PACK_ROWS = 65536
WHOLE_NUMBER = 10
#: Consecutive load numbers that one task orders.
BLOCK = 4096

STATS = ("pack_type", "no_obj", "no_nulls", "min_n", "max_n")


def newest_reports(packs: DataFrame) -> DataFrame:
    """One row per pack (attr_id, load_no, pack_no): the report of the highest ver, null lowest; of unlike rows of one ver the greatest."""
    last = packs.groupBy("attr_id", "load_no", "pack_no").agg(F.max(F.struct("ver", *STATS)).alias("r"))
    return last.select("attr_id", "load_no", "pack_no", *(f"r.{s}" for s in STATS))


def valid_statistics(most: int | None = PACK_ROWS) -> Column:
    """Whether the statistics of a pack, of at most ``most`` rows, can be true; never null."""
    counts = "no_obj >= 1 and no_nulls between 0 and no_obj" + (f" and no_obj <= {most}" if most else "")
    gone, held = "min_n is null and max_n is null", "min_n is not null and max_n is not null and min_n <= max_n"
    extrema = f"if(pack_type <=> {WHOLE_NUMBER} and no_nulls < no_obj, {held}, {gone})"
    return F.coalesce(F.expr(f"{counts} and {extrema}"), F.lit(False))


def load_profiles(checked: DataFrame) -> DataFrame:
    """Per (attr_id, load_no): packs, rows, nulls, lo, hi over the valid packs."""
    return (
        checked.where("valid")
        .groupBy("attr_id", "load_no")
        .agg(F.count(F.lit(1)).alias("packs"), F.sum("no_obj").alias("rows"), F.sum("no_nulls").alias("nulls"), F.min("min_n").alias("lo"), F.max("max_n").alias("hi"))
    )


def with_previous(loads: DataFrame) -> DataFrame:
    """Adds ``before``, the struct of the attribute's last earlier load, null for the first.

    Two windows, within blocks of load numbers and over the blocks' last rows, so an attribute
    with very many loads is spread over tasks.
    """
    block = F.floor(F.col("load_no") / BLOCK).alias("block")
    row = F.struct("load_no", "rows", "nulls", "lo", "hi")
    inner = loads.withColumn("block", block).withColumn("near", F.lag(row).over(Window.partitionBy("attr_id", "block").orderBy("load_no")))
    ends = inner.groupBy("attr_id", "block").agg(F.max(row).alias("end"))
    ends = ends.select(F.col("attr_id").alias("a"), F.col("block").alias("b"), F.lag("end").over(Window.partitionBy("attr_id").orderBy("block")).alias("far"))
    joined = inner.join(ends, F.col("attr_id").eqNullSafe(F.col("a")) & F.col("block").eqNullSafe(F.col("b")), "left")
    return joined.withColumn("before", F.coalesce("near", "far")).drop("near", "far", "a", "b", "block")


def changed_load(share: str = "0.10") -> Column:
    """Whether a load differs from ``before``: null shares by more than ``share``, or fewer than half the whole numbers of the wider range in both.

    Whole-number arithmetic in decimals, so limits are met exactly.
    """
    d = lambda c: F.col(c).cast("decimal(19,0)")
    skew = F.abs(d("nulls") * d("before.rows") - d("before.nulls") * d("rows"))
    moved = skew > (d("rows") * d("before.rows") * F.lit(share).cast("decimal(4,2)")).cast("decimal(38,2)")
    size = lambda p: d(f"{p}hi") - d(f"{p}lo") + 1
    common = F.greatest(F.least(d("hi"), d("before.hi")) - F.greatest(d("lo"), d("before.lo")) + 1, F.lit(0).cast("decimal(19,0)"))
    ranges = F.col("lo").isNotNull() & F.col("before.lo").isNotNull()
    shifted = ranges & (common * 2 < F.greatest(size(""), size("before.")))
    return F.col("before").isNotNull() & (moved | shifted)


def check_packs(packs: DataFrame) -> DataFrame:
    """(kind, attr_id, load_no, pack_no): the packs whose statistics can't be true and the loads that changed (pack_no -1).

    Nulls in a statistic count as the pack format says; null ids form a group of their own. An empty
    table gives no rows; other columns are ignored. Reports are combined before the shuffle.
    """
    return check_reports(newest_reports(packs))


def check_reports(reports: DataFrame, most: int | None = PACK_ROWS) -> DataFrame:
    """:func:`check_packs` over chunks that are reported once each, such as those of Parquet footers, with at most ``most`` rows a chunk."""
    checked = reports.withColumn("valid", valid_statistics(most))
    bad = checked.where("not valid").select(F.lit("pack").alias("kind"), "attr_id", "load_no", "pack_no")
    loads = with_previous(load_profiles(checked)).where(changed_load())
    return bad.unionByName(loads.select(F.lit("load").alias("kind"), "attr_id", "load_no", F.lit(-1).alias("pack_no")))


def attribute_profiles(packs: DataFrame) -> DataFrame:
    """Per attr_id: loads, packs, bad_packs, rows, nulls, null_share, min_n, max_n; counts and range over the valid packs."""
    checked = newest_reports(packs).withColumn("valid", valid_statistics())
    per_load = checked.groupBy("attr_id", "load_no").agg(
        F.count(F.lit(1)).alias("all_packs"),
        F.count_if("valid").alias("packs"),
        *(F.sum(F.when(F.col("valid"), F.col(c))).alias(n) for c, n in (("no_obj", "rows"), ("no_nulls", "nulls"))),
        F.min(F.when(F.col("valid"), F.col("min_n"))).alias("lo"),
        F.max(F.when(F.col("valid"), F.col("max_n"))).alias("hi"),
    )
    total = per_load.groupBy("attr_id").agg(
        F.count(F.lit(1)).alias("loads"),
        F.sum("packs").alias("packs"),
        F.sum(F.col("all_packs") - F.col("packs")).alias("bad_packs"),
        F.sum("rows").alias("rows"),
        F.sum("nulls").alias("nulls"),
        F.min("lo").alias("min_n"),
        F.max("hi").alias("max_n"),
    )
    return total.withColumn("null_share", F.round(F.try_divide(F.col("nulls").cast("double"), F.col("rows").cast("double")), 6))


def compare_profiles(before: DataFrame, after: DataFrame, share: float = 0.10) -> DataFrame:
    """(column_name, null_shift, distinct_ratio, changed) of two results of :func:`siltstone.sources.footers.profile_columns`.

    changed: the share of nulls moved by more than ``share``, the distinct counts differ by more than
    twofold, or the column is on one side only.
    """
    part = lambda df, p: df.select(F.col("column_name"), F.try_divide(F.col("nulls").cast("double"), F.col("rows").cast("double")).alias(f"{p}_share"), F.col("n_distinct").alias(f"{p}_n"))
    both = part(before, "b").join(part(after, "a"), "column_name", "full")
    shift, ratio = F.abs(F.col("a_share") - F.col("b_share")), F.try_divide(F.col("a_n").cast(T.DoubleType()), F.col("b_n").cast(T.DoubleType()))
    moved = F.coalesce(shift > share, F.col("a_share").isNull() != F.col("b_share").isNull()) | F.coalesce((ratio > 2) | (ratio < 0.5), F.col("a_n").isNull() != F.col("b_n").isNull())
    return both.select("column_name", shift.alias("null_shift"), ratio.alias("distinct_ratio"), moved.alias("changed"))
