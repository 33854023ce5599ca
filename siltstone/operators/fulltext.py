"""Full-text search: MATCH … AGAINST in natural language and in boolean mode."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """The words of a text: runs of letters, digits, apostrophes and underscores, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_']+)"), F.lit(1))


def _begins(tokens: Column, word: str) -> Column:
    return F.exists(tokens, lambda t: t.startswith(word))


def match_boolean(text: Column, query: str) -> Column:
    """IN BOOLEAN MODE: '+word' must be there, '-word' must not, of plain words one must be if none is required; 'word*' is a beginning.

    A null text never matches; a query without words matches nothing.
    """
    tokens = words(text)
    required, banned, optional = [], [], []
    for sign, word, star in re.findall(r"([+\-<>~]?)([\w']+)(\*?)", query.lower()):
        has = _begins(tokens, word) if star else F.array_contains(tokens, word)
        {"+": required, "-": banned}.get(sign, optional).append(has)
    test = F.lit(bool(required or optional))
    for r in required:
        test = test & r
    if not required and optional:
        some = optional[0]
        for o in optional[1:]:
            some = some | o
        test = test & some
    for b in banned:
        test = test & ~b
    return F.coalesce(test, F.lit(False))


def relevance(docs: DataFrame, id_column: str, text: str, query: str) -> DataFrame:
    """(id, score) of the rows that hold a word of the query: sum over its words of (1 + ln tf) * ln(N / df), rounded to 6 places.

    An own formula; the order, not the value, is comparable to the reference's. Words in more than
    half of the rows have no weight. Only the query's words are counted, so what is shuffled is
    a row per document and word of the query.
    """
    wanted = sorted(set(re.findall(r"[\w']+", query.lower())))
    hits = docs.select(F.col(id_column), F.explode(words(F.col(text))).alias("w")).where(F.col("w").isin(wanted)).groupBy(id_column, "w").agg(F.count(F.lit(1)).alias("tf"))
    total = docs.agg(F.count(text).alias("n"))
    weight = hits.groupBy("w").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(total), F.lit(True)).where("df * 2 <= n").select("w", F.log(F.col("n") / F.col("df")).alias("idf"))
    scored = hits.join(F.broadcast(weight), "w")  # no more rows than words of the query
    return scored.groupBy(id_column).agg(F.round(F.sum((1 + F.log("tf")) * F.col("idf")), 6).alias("score"))
