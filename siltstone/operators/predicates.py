"""Predicates in which the reference and Spark differ; three-valued unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.shared import unused


def xor(a: Column, b: Column) -> Column:
    """Null if either is."""
    return a != b


def is_unknown(c: Column) -> Column:
    """IS UNKNOWN; never null."""
    return c.isNull()


def like(c: Column, text: str, escape: str = "\\", fold: bool = False) -> Column:
    """LIKE with an escape character; ``fold`` ignores case."""
    return F.call_function("like", F.lower(c) if fold else c, F.lit(text.lower() if fold else text), F.lit(escape))


def row_in(columns: list[Column], rows: list[tuple]) -> Column:
    """(a, b) IN ((…), …) with the rules of nulls: unknown where only nulls stand against a match."""
    tests = None
    for row in rows:
        one = None
        for c, v in zip(columns, row):
            part = c == F.lit(v)
            one = part if one is None else one & part
        tests = one if tests is None else tests | one
    return tests if tests is not None else F.lit(False)


def compare_any(df: DataFrame, c: str, op: str, other: DataFrame, value: str) -> DataFrame:
    """Rows for which ``c op ANY (other.value)`` is true.

    '=' is a semi-join, '<>' and the orders compare with the least, the greatest and the number of
    values; the aggregate is one row.
    """
    if op == "=":
        return df.join(other.select(F.col(value).alias("__v")), F.col(c) == F.col("__v"), "left_semi")
    b = _bounds(df, other, value)
    x, low, high = F.col(c), b["low"], b["high"]
    tests = {"<": x < high, "<=": x <= high, ">": x > low, ">=": x >= low, "<>": (x != low) | (x != high)}
    return df.join(F.broadcast(b["table"]), tests[op], "left_semi")


def compare_all(df: DataFrame, c: str, op: str, other: DataFrame, value: str) -> DataFrame:
    """Rows for which ``c op ALL (other.value)`` is true: all of them if there are no values, none if a value is null."""
    b = _bounds(df, other, value)
    x, low, high = F.col(c), b["low"], b["high"]
    tests = {"<": x < low, "<=": x <= low, ">": x > high, ">=": x >= high, "=": (x == low) & (x == high)}
    if op == "<>":
        from siltstone.operators.joins import not_in

        return not_in(df, c, other, value)
    return df.join(F.broadcast(b["table"]), (b["n"] == 0) | ((b["gaps"] == 0) & tests[op]), "left_semi")


def _bounds(df: DataFrame, other: DataFrame, value: str) -> dict:
    """A table of one row and its columns: least and greatest value, number of values and of nulls."""
    name = unused("bounds", df)
    parts = F.struct(F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(value).isNull()).alias("gaps"))
    return {"table": other.agg(parts.alias(name))} | {p: F.col(f"{name}.{p}") for p in ("low", "high", "n", "gaps")}
