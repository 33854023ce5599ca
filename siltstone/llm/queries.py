"""Queries of the text problems, with their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import packing, pages, tokens
from siltstone.session import table
from siltstone.shared import materialize, spread


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of every document's text."""
    return tokens.encode(_documents(spark, d))


def p6_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Of every document the number of ids, of ids that begin inside a character, and whether decoding gives the text back."""
    return tokens.round_trip(_documents(spark, d))


def p6_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Of every document the characters that its ids reach and whether they cover them without gaps, in order."""
    found = tokens.offsets(_documents(spark, d))
    covered = F.forall(F.zip_with(F.concat(F.array(F.lit(0)), "after"), "first", lambda a, f: F.coalesce((f <= a) & (f >= a - 1), F.lit(True))), lambda x: x)
    return found.select("doc_id", F.coalesce(F.try_element_at("after", F.lit(-1)), F.lit(0)).cast("bigint").alias("chars"), covered.alias("covered"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sized = materialize(tokens.sizes(_documents(spark, d)), "sizes")
    return packing.pack(sized, table(spark, d, "containers"))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """All texts in as few containers of each kind as the plan finds: a row per container."""
    return _packed(spark, d)


def p7_summary(spark: SparkSession, d: str) -> DataFrame:
    """Of each kind of container how many were used, the tokens in them, the fewest that could hold them, and the share filled."""
    full = _packed(spark, d).groupBy("container").agg(F.count(F.lit(1)).alias("n_bins"), F.sum("fill").alias("tokens"), F.sum(F.size("doc_ids")).alias("n_items"))
    both = full.join(table(spark, d, "containers").distinct(), "container")
    return both.select("container", "n_bins", "n_items", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_bins"), F.round(F.col("tokens") / (F.col("n_bins") * F.col("capacity")), 5).alias("filled"))


def p7_checked(spark: SparkSession, d: str) -> DataFrame:
    """Of each kind of container the texts in it, and whether each is there whole, once, in containers that aren't overfull."""
    sized = materialize(tokens.sizes(_documents(spark, d)), "sizes")
    bins = packing.pack(sized, table(spark, d, "containers")).join(table(spark, d, "containers").distinct(), "container")
    parts = bins.select("container", "capacity", "fill", F.explode(F.arrays_zip("doc_ids", "starts", "lens")).alias("p"), F.aggregate("lens", F.lit(0).cast("bigint"), lambda x, y: x + y).alias("held"))
    fits = (F.col("fill") <= F.col("capacity")) & (F.col("fill") == F.col("held"))
    own = parts.groupBy("container", F.col("p.doc_ids").alias("doc_id")).agg(F.sum("p.lens").alias("n"), F.every(fits).alias("fits"), F.every((F.col("p.starts") == 0) | (F.col("p.starts") % F.col("capacity") == 0)).alias("cut"))
    there = own.join(sized, "doc_id", "left").select("container", (F.col("fits") & F.col("cut") & F.coalesce(F.col("n") == F.col("n_tokens"), F.lit(False))).alias("whole"))
    return there.groupBy("container").agg(F.count(F.lit(1)).alias("texts"), F.every("whole").alias("whole"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """doc_id of the pages made of keywords, links or tags."""
    documents = table(spark, d, "documents")
    return pages.find_stuffed(_documents(spark, d), pages.train(documents, table(spark, d, "pagelabels"))).select("doc_id")


QUERIES = {f.__name__: f for f in (p6_ids, p6_roundtrip, p6_offsets, p7_packed, p7_summary, p7_checked, p8_found)}

ORACLE: dict[str, str] = {
    "p6_offsets": "select doc_id, length(coalesce(text, ''))::bigint as chars, true as covered from documents",
    "p7_checked": "select container, count(*) as texts, true as whole from documents, (select distinct container from containers) where text <> '' group by 1",
}
