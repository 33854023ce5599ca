"""Aggregates beyond the built-in ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the longest result of GROUP_CONCAT unless set.
CONCAT_LENGTH = 1024


def group_concat(x: Column, order: Sequence[Column] = (), separator: str = ",", most: int = CONCAT_LENGTH) -> Column:
    """GROUP_CONCAT: the texts that aren't null in order of ``order`` (else of x), cut at ``most`` characters; null if there are none."""
    keys = list(order) or [x]
    entry = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)), x.cast("string").alias("x"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(x.isNotNull(), entry))), lambda e: e["x"]), separator)
    return F.when(F.count(x) > 0, F.substring(joined, 1, most))


def bit_aggregate(kind: str, c: Column) -> Column:
    """BIT_AND, BIT_OR or BIT_XOR over numbers or texts of numbers; what is no number is left out."""
    value = F.round(c.try_cast("decimal(38,6)"), 0).try_cast("bigint")
    return {"and": F.bit_and, "or": F.bit_or, "xor": F.bit_xor}[kind](value)


def count_distinct(*columns: str) -> Column:
    """COUNT(DISTINCT a, b, …): rows with a null in any of them don't count."""
    return F.count_distinct(*(F.col(c) for c in columns))


def spread_distinct(df: DataFrame, keys: Sequence[str], c: str) -> DataFrame:
    """(keys, n): distinct values of c per group in two aggregations, so that the values of one hot group spread over all tasks; nulls don't count."""
    return df.select(*keys, c).distinct().groupBy(*keys).agg(F.count(c).alias("n"))


def analyse(df: DataFrame) -> DataFrame:
    """PROCEDURE ANALYSE: (field_name, min_value, max_value, min_length, max_length, empties_or_zeros, nulls, avg_value, std) of every flat column.

    One aggregation over all columns, then a row per column. avg and std are of numbers, rounded to 4
    places, else the average length of the texts.
    """
    flat = [f for f in df.schema if f.dataType.simpleString().split("(")[0] in ("string", "tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean", "date", "timestamp", "timestamp_ntz")]
    measures = []
    for f in flat:
        c, text = F.col(f"`{f.name}`"), F.col(f"`{f.name}`").cast("string")
        number = f.dataType.simpleString().split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
        gap = (c == 0) if number else (text == "")
        mean = c.cast("double") if number else F.char_length(text).cast("double")
        measures.append(
            F.struct(
                F.lit(f.name).alias("field_name"), F.min(c).cast("string").alias("min_value"), F.max(c).cast("string").alias("max_value"),
                F.min(F.char_length(text)).alias("min_length"), F.max(F.char_length(text)).alias("max_length"),
                F.count_if(gap).alias("empties_or_zeros"), F.count_if(c.isNull()).alias("nulls"),
                F.round(F.avg(mean), 4).alias("avg_value"), (F.round(F.stddev_pop(mean), 4) if number else F.lit(None).cast("double")).alias("std"),
            )
        )
    return df.agg(F.array(*measures).alias("m")).select(F.inline("m"))


def with_total(df: DataFrame, keys: Sequence[str], **measures: Column) -> DataFrame:
    """GROUP BY … WITH ROLLUP; ``level`` tells how many keys are summed up, as nulls may also be keys."""
    return df.rollup(*keys).agg(*(c.alias(n) for n, c in measures.items()), F.grouping_id().alias("__g")).withColumn("level", F.bit_count("__g")).drop("__g")
