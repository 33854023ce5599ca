"""What statistics alone can tell: rough checks of predicates on packs, approximate answers, domain splits, interval sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.operators.sorting import range_split, split_of


def rough_check(op: str, value, low: Column, high: Column, nulls: Column, rows: Column) -> Column:
    """'none', 'some' or 'all' of a pack's rows meet ``column op value``, from its extrema, nulls and rows; 'some' where it can't be told.

    A pack of nulls meets nothing; nulls keep a pack from 'all'. ``value`` is a pair for 'between'.
    """
    v = value if isinstance(value, tuple) else (value, value)
    a, b = F.lit(v[0]), F.lit(v[1])
    none = {"=": (a < low) | (a > high), "<": low >= a, "<=": low > a, ">": high <= a, ">=": high < a, "<>": (low == a) & (high == a), "between": (high < a) | (low > b)}[op]
    every = {"=": (low == a) & (high == a), "<": high < a, "<=": high <= a, ">": low > a, ">=": low >= a, "<>": (a < low) | (a > high), "between": (low >= a) & (high <= b)}[op]
    return F.when((nulls == rows) | none, "none").when((nulls == 0) & every, "all").otherwise("some")


def rough_totals(packs: DataFrame, op: str, value, low: str = "min_n", high: str = "max_n", nulls: str = "no_nulls", rows: str = "no_obj") -> DataFrame:
    """(verdict, packs, rows): how much of a column a predicate leaves to be read."""
    verdict = rough_check(op, value, F.col(low), F.col(high), F.col(nulls), F.col(rows))
    return packs.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("packs"), F.sum(rows).alias("rows"))


def presence_histogram(df: DataFrame, pack: Column, value: str, bins: int = 1024) -> DataFrame:
    """(pack, low, high, bits): which of ``bins`` equal parts of a pack's range hold a value, as a sorted array of their numbers."""
    ranged = df.select(pack.alias("pack"), F.col(value).cast("double").alias("v")).where("v is not null")
    ends = ranged.groupBy("pack").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    part = F.least(F.floor((F.col("v") - F.col("low")) / F.greatest((F.col("high") - F.col("low")) / bins, F.lit(1e-300))), F.lit(bins - 1)).cast("int")
    marked = ranged.join(ends, "pack").select("pack", "low", "high", part.alias("bit")).distinct()
    return marked.groupBy("pack", "low", "high").agg(F.sort_array(F.collect_list("bit")).alias("bits"))  # at most ``bins`` a pack


def character_map(df: DataFrame, pack: Column, text: str, positions: int = 64) -> DataFrame:
    """(pack, position, characters): the characters that occur at each of the first positions of a pack's texts, sorted."""
    at = F.posexplode(F.split(F.substring(F.col(text), 1, positions), ""))
    spread = df.select(pack.alias("pack"), at.alias("position", "c")).where("c <> ''").distinct()
    return spread.groupBy("pack", "position").agg(F.array_join(F.sort_array(F.collect_list("c")), "").alias("characters"))


def may_be_like(maps: DataFrame, prefix: str, positions: int = 64) -> DataFrame:
    """The packs of a :func:`character_map` of so many ``positions`` in which a text may begin with ``prefix``; what lies beyond them isn't tested."""
    prefix = prefix[:positions]
    tests = [(F.col("position") == i) & F.col("characters").contains(c) for i, c in enumerate(prefix)]
    hit = sum((t.cast("int") for t in tests[1:]), tests[0].cast("int"))
    return maps.groupBy("pack").agg(F.sum(hit).alias("n")).where(F.col("n") == len(prefix)).select("pack")


def rough_select(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """SELECT ROUGHLY: one row with rows, and of each column its bounds and about how many values it has (within 5 %)."""
    parts = [F.count(F.lit(1)).alias("rows")]
    for c in columns:
        parts += [F.min(c).alias(f"{c}_low"), F.max(c).alias(f"{c}_high"), F.approx_count_distinct(c, 0.05).alias(f"{c}_values")]
    return df.agg(*parts)


def split_address(c: Column) -> Column:
    """Domain rule IPv4: four numbers of a dotted address, or null for an outlier."""
    parts = F.split(c, r"\.")
    fits = c.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(parts, lambda p: p.try_cast("int") <= 255)
    return F.when(fits, F.struct(*(parts.getItem(i).try_cast("int").alias(n) for i, n in enumerate("abcd"))))


def split_halves(c: Column) -> Column:
    """Domain rule HALVE: the first and the second half of a text's characters."""
    half = F.floor(F.char_length(c) / 2).cast("int")
    return F.when(c.isNotNull(), F.struct(F.left(c, half).alias("head"), c.substr(half + 1, F.char_length(c)).alias("tail")))


def split_mask(c: Column, mask: str) -> Column:
    """A domain rule of literal texts and %d (digits) and %s (anything): the variable parts, or null for an outlier."""
    import re

    pieces = re.split(r"(%d|%s)", mask)
    regex = "^" + "".join(r"(\d+)" if p == "%d" else "(.*?)" if p == "%s" else re.escape(p) for p in pieces) + "$"
    n = sum(p in ("%d", "%s") for p in pieces)
    return F.when(c.rlike(regex), F.array(*(F.regexp_extract(c, regex, i + 1) for i in range(n))))


def visible(df: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Rows that a delete mask (a table of keys) leaves."""
    return df.join(deleted.select(key).distinct(), key, "left_anti")


def merge_intervals(df: DataFrame, low: str, high: str, group: Sequence[str] = (), parts: int = 64) -> DataFrame:
    """(group, low, high): the interval set, whole numbers with both ends included; adjoining intervals join.

    Gaps and islands in blocks of starting points, cut at quantiles, so that a group with very many
    intervals is spread over tasks; what reaches over from earlier blocks, and the number of islands in them, comes from
    a row per block. Rows with a null or inverted interval are left out.
    """
    rows = df.where(F.col(low) <= F.col(high)).select(*group, F.col(low).alias("__l"), F.col(high).alias("__h")).distinct()
    rows = rows.withColumn("__b", split_of(F.col("__l"), range_split(rows, "__l", parts)))
    w = Window.partitionBy(*group, "__b").orderBy("__l", "__h")
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    tops = rows.groupBy(*group, "__b").agg(F.max("__h").alias("__top"))
    far = tops.select(*(F.col(g).alias(f"__g_{g}") for g in group), F.col("__b").alias("__fb"), F.max("__top").over(before).alias("__far"))
    reached = rows.join(far, _same_block(group, "__fb"), "left").drop("__fb", *(f"__g_{g}" for g in group))
    edge = F.greatest(F.max("__h").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("__far"))
    marked = reached.withColumn("__new", F.when(edge.isNull() | (F.col("__l") > edge + 1), 1).otherwise(0)).withColumn("__n", F.sum("__new").over(w))
    counts = marked.groupBy(*group, "__b").agg(F.sum("__new").alias("__k"))
    base = counts.select(*(F.col(g).alias(f"__g_{g}") for g in group), F.col("__b").alias("__fb"), F.coalesce(F.sum("__k").over(before), F.lit(0)).alias("__base"))
    numbered = marked.join(base, _same_block(group, "__fb"), "left").withColumn("__island", F.col("__base") + F.col("__n"))
    return numbered.groupBy(*group, "__island").agg(F.min("__l").alias(low), F.max("__h").alias(high)).drop("__island")


def _same_block(group: Sequence[str], block: str) -> Column:
    test = F.col("__b") == F.col(block)
    for g in group:
        test = test & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    return test


def remove_interval(intervals: DataFrame, low: str, high: str, gone: tuple[int, int]) -> DataFrame:
    """The interval set without [gone]: an interval may be cut in two."""
    a, b = gone
    left = F.struct(F.col(low).alias("l"), F.least(F.col(high), F.lit(a - 1)).alias("h"))
    right = F.struct(F.greatest(F.col(low), F.lit(b + 1)).alias("l"), F.col(high).alias("h"))
    rest = [c for c in intervals.columns if c not in (low, high)]
    return intervals.select(*rest, F.inline(F.filter(F.array(left, right), lambda p: p["l"] <= p["h"]))).withColumnsRenamed({"l": low, "h": high}).distinct()
