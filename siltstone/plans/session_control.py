"""Queries of statements that define tables or control a session."""

from __future__ import annotations

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.plans.dialect import run
from siltstone.plans.registry import Registry
from siltstone.session import table
from siltstone.shared import scratch
from siltstone.sources.tables import discard

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
t = table


@R.add("select o_orderkey, upper(o_orderstatus) as s, '{d ''x''}' as text from orders where o_orderdate >= date '1998-01-01' and o_orderdate < timestamp '1998-02-01 12:00:00'")
def odbc_escapes(spark: SparkSession, d: str) -> DataFrame:
    """{d …}, {ts …}, {fn …} (O-229)."""
    sql = "select o_orderkey, {fn upper(o_orderstatus)} as s, '{d ''x''}' as text from orders where o_orderdate >= {d '1998-01-01'} and o_orderdate < {ts '1998-02-01 12:00:00'}"
    return run(spark, sql.replace("''x''", "\\'x\\'"), orders=t(spark, d, "orders"))


@R.add("select true as named, true as columns")
def show_create(spark: SparkSession, d: str) -> DataFrame:
    """SHOW CREATE TABLE of a stored table (O-291)."""
    name = "t_" + scratch(spark, "x").rsplit("-", 1)[1]
    t(spark, d, "region").write.option("path", scratch(spark, "table")).saveAsTable(name)
    try:
        text = spark.sql(f"show create table {name}").first()[0]
    finally:
        spark.sql(f"drop table {name}")
    return spark.createDataFrame([(name in text, "r_name STRING" in text)], "named boolean, columns boolean")


@R.add("select count(*) as rows, true as renamed from region")
def rename_table(spark: SparkSession, d: str) -> DataFrame:
    """RENAME TABLE (O-292)."""
    name = "t_" + scratch(spark, "x").rsplit("-", 1)[1]
    path = scratch(spark, "table")
    t(spark, d, "region").write.option("path", path).saveAsTable(name)
    spark.sql(f"alter table {name} rename to {name}_new")
    try:
        renamed = spark.catalog.tableExists(f"{name}_new") and not spark.catalog.tableExists(name)
    finally:
        spark.sql(f"drop table {name}_new")
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"), F.lit(renamed).alias("renamed"))


@R.add("select true as cancelled")
def cancel_query(spark: SparkSession, d: str) -> DataFrame:
    """KILL: the jobs of a group are cancelled; the query would end by itself after some seconds (O-297)."""
    context, failed = spark.sparkContext, []
    group = "kill_" + scratch(spark, "x").rsplit("-", 1)[1]

    def long() -> None:
        context.setJobGroup(group, "to be cancelled", interruptOnCancel=True)
        try:
            discard(spark.range(3 * 10**10).selectExpr("sum(id % 7) as s"))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    thread = InheritableThread(target=long, session=spark)
    thread.start()
    while thread.is_alive():
        context.cancelJobGroup(group)
        thread.join(0.3)
    return spark.createDataFrame([(bool(failed) and "cancel" in str(failed[0]).lower(),)], "cancelled boolean")
