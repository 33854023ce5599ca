"""Text of the reference's SQL dialect that Spark's parser doesn't know, rewritten."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

ESCAPE = re.compile(r"\{\s*(d|t|ts|fn|oj)\s+((?:'[^']*'|[^{}'])*)\}", re.IGNORECASE)


def rewrite(sql: str) -> str:
    """ODBC escapes as plain SQL; texts in quotes stay as they are.

    {d '…'} and {ts '…'} become literals, {t '…'} a text, {fn f(…)} and {oj a left outer join b} their content.
    """

    def one(m: re.Match) -> str:
        kind, inner = m.group(1).lower(), m.group(2).strip()
        return {"d": f"date {inner}", "ts": f"timestamp_ntz {inner}"}.get(kind, inner)

    out, at = "", 0
    for quoted in re.finditer(r"\{[^{}]*\}|'(?:[^'\\]|''|\\.)*'", sql):
        out += sql[at : quoted.start()]
        text = quoted.group(0)
        out += ESCAPE.sub(one, text) if text[0] == "{" else text
        at = quoted.end()
    return out + sql[at:]


def run(spark: SparkSession, sql: str, args: dict | None = None, **tables: DataFrame) -> DataFrame:
    """A statement of the dialect over the named tables, with ``:name`` parameters."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(rewrite(sql), args or {})
