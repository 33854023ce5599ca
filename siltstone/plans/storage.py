"""Queries of sources, sinks, statistics and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators import dml as D
from siltstone.operators import knowledge as K
from siltstone.operators import sorting as S
from siltstone.operators.joins import is_small
from siltstone.plans.registry import Registry
from siltstone.session import register, table
from siltstone.shared import own_folder, scratch
from siltstone.sources import delimited as L
from siltstone.sources import tables as B
from siltstone.sources.footers import chunk_statistics, profile_columns
from siltstone.streaming import events as E

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
t = table
c = F.col


@R.add("select c_custkey, case when c_custkey % 5 = 0 then null else c_name || ' \"x\" ; y' end as c_name, c_acctbal, c_mktsegment from customer")
def io_delimited(spark: SparkSession, d: str) -> DataFrame:
    """Export with separator, enclosure, escape and null text, and load again (O-3, O-4, O-6 to O-8, O-15, O-26, O-28)."""
    name = F.when(c("c_custkey") % 5 != 0, F.concat(c("c_name"), F.lit(' "x" ; y')))
    df = t(spark, d, "customer").select("c_custkey", name.alias("c_name"), "c_acctbal", "c_mktsegment")
    path = scratch(spark, "export")
    L.export(df, path)
    return L.split_errors(L.load(spark, path, df.schema))[0]


@R.add("select count(*) filter (where o_orderkey % 100 <> 0) as rows, count(*) filter (where o_orderkey % 100 = 0) as errors from orders")
def io_errors(spark: SparkSession, d: str) -> DataFrame:
    """Lines that don't fit are kept apart from the rows (O-10)."""
    path = scratch(spark, "lines")
    line = F.when(c("o_orderkey") % 100 == 0, F.lit("x;y")).otherwise(F.concat_ws(";", "o_orderkey", "o_totalprice"))
    t(spark, d, "orders").select(line.alias("value")).write.text(path)
    loaded = L.load(spark, path, T.StructType([T.StructField("k", T.LongType()), T.StructField("p", T.DoubleType())]))
    return loaded.select(F.count_if(c("_error").isNull() & c("k").isNotNull()).alias("rows"), F.count_if(c("_error").isNotNull()).alias("errors"))


@R.add("select n_nationkey as k, n_name as n from nation where n_nationkey > 1")
def io_line_format(spark: SparkSession, d: str) -> DataFrame:
    """Byte order mark, skipped lines and a line starter (O-3, O-4)."""
    path = scratch(spark, "lines")
    x = t(spark, d, "nation").select("n_nationkey", F.concat(F.when(c("n_nationkey") == 0, F.lit("﻿")).otherwise(""), F.lit(">>"), "n_nationkey", F.lit(";"), "n_name").alias("value"))
    x.coalesce(1).sortWithinPartitions("n_nationkey").select("value").write.text(path)
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("n", T.StringType())])
    return L.split_errors(L.load(spark, path, schema, L.TextFormat(skip=2, starter=">>")))[0]


@R.add("select l_orderkey, nullif(l_linenumber, 3) as l_linenumber, l_quantity from lineitem")
def io_binary(spark: SparkSession, d: str) -> DataFrame:
    """Binary rows written and loaded (O-5, O-11)."""
    df = t(spark, d, "lineitem").select("l_orderkey", F.nullif(c("l_linenumber"), F.lit(3)).alias("l_linenumber"), "l_quantity")
    path = scratch(spark, "binary")
    L.write_binary(df, path)
    return L.read_binary(spark, path, df.schema)


@R.add("select n_nationkey, n_name from nation union all select n_nationkey + 100, n_name from nation")
def io_tables(spark: SparkSession, d: str) -> DataFrame:
    """CREATE TABLE … SELECT, INSERT … SELECT, a merge table and an archive (O-9, O-16, O-20, O-29, O-30, O-37)."""
    x = t(spark, d, "nation").select("n_nationkey", "n_name")
    a, b = scratch(spark, "table"), scratch(spark, "table")
    D.write_table(x.where("n_nationkey < 10"), a)
    D.write_table(x.where("n_nationkey >= 10"), a, "append")
    B.archive(x.select((c("n_nationkey") + 100).alias("n_nationkey"), "n_name"), b)
    return B.merge_table(spark, a, b)


@R.add("select 'region' as name, count(*) as rows from region union all select 'nation', count(*) from nation")
def io_backup(spark: SparkSession, d: str) -> DataFrame:
    """Snapshot with a content index, restored and checked (O-38)."""
    path = scratch(spark, "backup")
    B.backup({n: t(spark, d, n) for n in ("region", "nation")}, path)
    back = B.restore(spark, path)
    return back["region"].agg(F.lit("region").alias("name"), F.count(F.lit(1)).alias("rows")).union(back["nation"].agg(F.lit("nation"), F.count(F.lit(1))))


@R.add("select s_suppkey as id, s_name as name, s_acctbal as balance from supplier where s_suppkey > 10")
def io_jdbc(spark: SparkSession, d: str) -> DataFrame:
    """Rows appended to a remote table and read from it in ranges: here an embedded database of the driver, which reads and writes for executors that can't reach it (O-13, O-19, O-36)."""
    place = {"url": f"jdbc:derby:{own_folder()}/db;create=true", "table": "suppliers"}
    x = t(spark, d, "supplier").select(c("s_suppkey").alias("id"), c("s_name").alias("name"), c("s_acctbal").alias("balance"))
    B.append_remote(x, **place)
    back = B.remote_table(spark, **place, split="id", bounds=(0, x.count()), parts=4)
    return back.select(*(c(n).alias(n.lower()) for n in back.columns)).where("id > 10")


@R.add("select count(*) as files, true as whole from region where r_regionkey = 0")
def io_load_file(spark: SparkSession, d: str) -> DataFrame:
    """LOAD_FILE: a file as a value (O-5, O-199)."""
    return B.file_text(spark, f"{d}/region.parquet").agg(F.count(F.lit(1)).alias("files"), F.every(F.octet_length("content") == c("length")).alias("whole"))


@R.add("select count(*) as rows, count(*) as kept from orders where o_orderstatus = 'F'")
def io_blackhole(spark: SparkSession, d: str) -> DataFrame:
    """A sink that keeps nothing, beside a cached table (O-17, O-18, O-295, O-299)."""
    x = t(spark, d, "orders").where("o_orderstatus = 'F'")
    B.discard(x)
    return x.agg(F.count(F.lit(1)).alias("rows"), F.count("o_orderkey").alias("kept"))


@R.add("select l_shipdate, l_orderkey, l_linenumber from lineitem where l_shipdate between timestamp '1995-03-01' and timestamp '1995-03-31'")
def sorted_load(spark: SparkSession, d: str) -> DataFrame:
    """Range-sorted load, then a range query that footers narrow (O-11, O-37, O-264 to O-266)."""
    path = scratch(spark, "sorted")
    S.sorted_load(t(spark, d, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber"), path, "l_shipdate", files=8)
    ntz = lambda v: F.lit(v).cast("timestamp_ntz")
    return spark.read.parquet(path).where(c("l_shipdate").between(ntz("1995-03-01"), ntz("1995-03-31")))


@R.add("select 0::bigint as overlaps, (select count(*) from part) as rows, (select count(*) from part where p_name like 'a%') as begins")
def key_verify(spark: SparkSession, d: str) -> DataFrame:
    """Check of a sorted load's order, with the keys filtered by LIKE (O-279)."""
    path = scratch(spark, "sorted")
    S.sorted_load(t(spark, d, "part").select("p_name"), path, "p_name", files=6)
    x = spark.read.parquet(path)
    overlaps = S.order_violations(x, "p_name").agg(F.count(F.lit(1)).alias("overlaps"))
    return overlaps.join(x.agg(F.count(F.lit(1)).alias("rows"), F.count_if(c("p_name").like("a%")).alias("begins")), F.lit(True))  # one row by one row


@R.add("""select 'l_orderkey' as column_name, count(*) as rows, min(l_orderkey) as low, max(l_orderkey) as high from lineitem
union all select 'l_linenumber', count(*), min(l_linenumber), max(l_linenumber) from lineitem
union all select 'l_partkey', count(*), min(l_partkey), max(l_partkey) from lineitem union all select 'l_suppkey', count(*), min(l_suppkey), max(l_suppkey) from lineitem""")
def footer_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """COUNT, MIN, MAX from Parquet footers alone (O-123, O-274)."""
    chunks = chunk_statistics(spark, f"{d}/lineitem.parquet", distinct=False, columns=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return chunks.groupBy("column_name").agg(F.sum("rows").alias("rows"), F.min(c("low").cast("bigint")).alias("low"), F.max(c("high").cast("bigint")).alias("high"))


@R.add("""select case when no_nulls = no_obj or min_n > 500 or max_n < 100 then 'none' when no_nulls = 0 and min_n >= 100 and max_n <= 500 then 'all' else 'some' end as verdict, count(*) as packs, sum(no_obj)::bigint as rows
from msgibrcattrpack where pack_type = 10 group by 1""")
def rough_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Rough check of BETWEEN on packs: none, some or all rows (O-259, O-260)."""
    return K.rough_totals(t(spark, d, "msgibrcattrpack").where("pack_type = 10"), "between", (100, 500))


@R.add("""with v as (select (l_orderkey // 65536)::bigint as pack, l_extendedprice as v from lineitem), e as (select pack, min(v) as low, max(v) as high from v group by 1),
b as (select distinct pack, low, high, least(floor((v - low) / greatest((high - low) / 1024, 1e-300)), 1023)::integer as bit from v join e using (pack))
select pack, low, high, count(*) as set_bits from b group by 1, 2, 3""")
def presence_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Which of 1024 parts of a pack's range hold values (O-261, O-262)."""
    h = K.presence_histogram(t(spark, d, "lineitem"), F.floor(c("l_orderkey") / 65536).cast("bigint"), "l_extendedprice")
    return h.select("pack", "low", "high", F.size("bits").cast("bigint").alias("set_bits"))


@R.add("""with p as (select (p_partkey // 500)::bigint as pack, p_name as s from part), x as (select distinct pack, i as position, substr(s, i + 1, 1) as ch from p, range(64) r(i) where i < length(s))
select pack, position::integer as position, string_agg(ch, '' order by ch) as characters from x group by 1, 2""")
def character_map(spark: SparkSession, d: str) -> DataFrame:
    """Characters at each position of a pack's texts (O-263)."""
    return K.character_map(t(spark, d, "part"), F.floor(c("p_partkey") / 500).cast("bigint"), "p_name")


@R.add("select count(*) as found from part where p_name like 'bl%'")
def like_pruned(spark: SparkSession, d: str) -> DataFrame:
    """LIKE over the packs that a character map leaves (O-263)."""
    p = t(spark, d, "part").withColumn("pack", F.floor(c("p_partkey") / 100).cast("bigint"))
    packs = K.may_be_like(K.character_map(p, c("pack"), "p_name"), "bl")
    return p.join(packs, "pack", "left_semi").where("p_name like 'bl%'").agg(F.count(F.lit(1)).alias("found"))


@R.add("""select count(*) as rows, min(l_quantity) as l_quantity_low, max(l_quantity) as l_quantity_high, true as about_right from lineitem""")
def rough_query(spark: SparkSession, d: str) -> DataFrame:
    """SELECT ROUGHLY: bounds and about how many values (O-267)."""
    x = t(spark, d, "lineitem")
    return K.rough_select(x, ["l_quantity"]).select("rows", "l_quantity_low", "l_quantity_high", c("l_quantity_values").between(40, 60).alias("about_right"))


@R.add("""select c_custkey, (c_custkey % 200)::integer as a, (c_custkey // 200 % 250)::integer as b, 7 as cc, case when c_custkey % 3 = 0 then null else 1 end as dd, left(c_name, length(c_name) // 2) as head, substr(c_name, length(c_name) // 2 + 1) as tail,
regexp_extract(c_name, '^(.*?)#(\\d+)$', 1) as m1, regexp_extract(c_name, '^(.*?)#(\\d+)$', 2) as m2 from customer""")
def domain_split(spark: SparkSession, d: str) -> DataFrame:
    """Domain rules: IPv4, halves, a mask, and outliers (O-268)."""
    last = F.when(c("c_custkey") % 3 == 0, F.lit("x")).otherwise("1")
    ip = F.concat_ws(".", (c("c_custkey") % 200).cast("string"), F.floor(c("c_custkey") / 200 % 250).cast("string"), F.lit("7"), F.lit("1"))
    x = t(spark, d, "customer").select("c_custkey", K.split_address(ip).alias("i"), K.split_address(F.concat_ws(".", F.lit("1.1.1"), last)).alias("o"), K.split_halves(c("c_name")).alias("h"), K.split_mask(c("c_name"), "%s#%d").alias("m"))
    return x.select("c_custkey", "i.a", "i.b", c("i.c").alias("cc"), c("o.d").alias("dd"), "h.head", "h.tail", F.coalesce(c("m")[0], F.lit("")).alias("m1"), F.coalesce(c("m")[1], F.lit("")).alias("m2"))


@R.add("select l_orderkey, l_linenumber from lineitem where l_orderkey not in (select o_orderkey from orders where o_totalprice < 20000)")
def delete_mask(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a delete mask leaves (O-270)."""
    gone = t(spark, d, "orders").where("o_totalprice < 20000").select(c("o_orderkey").alias("l_orderkey"))
    return K.visible(t(spark, d, "lineitem"), gone, "l_orderkey").select("l_orderkey", "l_linenumber")


@R.add("""with r as (select distinct from_obj_id as l, upto_obj_id as h from runlog where from_obj_id <= upto_obj_id),
m as (select *, max(h) over (order by l, h rows between unbounded preceding and 1 preceding) as p from r),
g as (select *, sum(case when p is null or l > p + 1 then 1 else 0 end) over (order by l, h) as g from m),
s as (select min(l) as l, max(h) as h from g group by g)
select l as from_obj_id, least(h, 2999) as upto_obj_id from s where l <= least(h, 2999) union all select greatest(l, 4001), h from s where greatest(l, 4001) <= h""")
def interval_set(spark: SparkSession, d: str) -> DataFrame:
    """Ranges joined into an interval set, and one taken out (O-281)."""
    return K.remove_interval(K.merge_intervals(t(spark, d, "runlog"), "from_obj_id", "upto_obj_id"), "from_obj_id", "upto_obj_id", (3000, 4000)).select("from_obj_id", "upto_obj_id")


@R.add("select o_orderkey, o_totalprice from orders where o_orderpriority like '1%' order by o_totalprice desc, o_orderkey limit 15 offset 5")
def search_query(spark: SparkSession, d: str) -> DataFrame:
    """A search message: filter, sort, start, rows, fields (O-280)."""
    return S.top(t(spark, d, "orders").where("o_orderpriority like '1%'"), 15, c("o_totalprice").desc(), c("o_orderkey"), offset=5).select("o_orderkey", "o_totalprice")


@R.add("select true as pruned, true as pushed")
def explain_plan(spark: SparkSession, d: str) -> DataFrame:
    """EXPLAIN: what of a query reaches the scan (O-283, O-284)."""
    text = B.plan_text(t(spark, d, "orders").where("o_totalprice > 1000").select("o_orderkey"))
    return spark.createDataFrame([("o_orderdate" not in text, "GreaterThan(o_totalprice,1000" in text)], "pruned boolean, pushed boolean")


@R.add("select true as refused, true as allowed")
def safe_select(spark: SparkSession, d: str) -> DataFrame:
    """A query whose estimated size is too large is refused (O-294)."""
    big = t(spark, d, "lineitem").alias("a").join(t(spark, d, "lineitem").alias("b"), F.lit(True))
    try:
        B.guard(big, 10**9)
        refused = False
    except ValueError:
        refused = True
    allowed = is_small(B.guard(t(spark, d, "region"), 10**9))
    return spark.createDataFrame([(refused, allowed)], "refused boolean, allowed boolean")


@R.add("select o_orderstatus, count(*) as n from orders where o_orderstatus in ('F', 'O') group by 1")
def partitioned_table(spark: SparkSession, d: str) -> DataFrame:
    """A table partitioned by list, of which a query reads two parts (O-284, O-287)."""
    path = scratch(spark, "parts")
    t(spark, d, "orders").select("o_orderkey", "o_orderstatus").repartition("o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    return spark.read.schema("o_orderkey bigint, o_orderstatus string").parquet(path).where(c("o_orderstatus").isin("F", "O")).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@R.add("select column_name, count(*) as rows from (select unnest(['r_regionkey', 'r_name']) as column_name) x, region group by 1")
def table_check(spark: SparkSession, d: str) -> DataFrame:
    """CHECK TABLE and ANALYZE TABLE: every column has the table's rows (O-271, O-290)."""
    return profile_columns(spark, f"{d}/region.parquet").select("column_name", "rows")


@R.add("select count(*) as rows, ceil(count(*) / 4096)::integer as blocks from part")
def block_scan(spark: SparkSession, d: str) -> DataFrame:
    """Block scan API: blocks until an empty one (O-12, O-24, O-36, O-39, O-246)."""
    sizes = [len(b) for b in B.blocks(t(spark, d, "part").select("p_partkey"), 4096)]
    return spark.createDataFrame([(sum(sizes), sum(s > 0 for s in sizes))], "rows bigint, blocks int")


@R.add("select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows, an extension (O-248)."""
    return E.tumbling(t(spark, d, "events").withColumn("ts", c("ts").cast("timestamp")), "ts", "1 hour", "event_type").withColumn("window_start", c("window_start").cast("timestamp_ntz"))


@R.add("""with m as (select user_id, ts, case when ts - lag(ts) over w < interval 30 minute then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
g as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as g from m)
select user_id, min(ts) as session_start, max(ts) + interval 30 minute as session_end, count(*) as n from g group by user_id, g""")
def events_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Session windows, an extension (O-248)."""
    s = E.sessions(t(spark, d, "events").withColumn("ts", c("ts").cast("timestamp")), "ts", "30 minutes", "user_id")
    return s.withColumn("session_start", c("session_start").cast("timestamp_ntz")).withColumn("session_end", c("session_end").cast("timestamp_ntz"))


@R.add("select date_trunc('day', ts) as window_start, count(*) as n, round(sum(value), 4) as total from events group by 1")
def events_streamed(spark: SparkSession, d: str) -> DataFrame:
    """The same aggregation over a file stream, run to its end and read from its sink (O-244, O-246, O-248)."""
    name = "siltstone_" + scratch(spark, "s").rsplit("-", 1)[1]
    source = t(spark, d, "events").select("ts", "value")
    path, out = scratch(spark, "feed"), scratch(spark, name)
    source.write.parquet(path)
    stream = spark.readStream.schema(source.schema).parquet(path).withColumn("ts", c("ts").cast("timestamp"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")

    query = E.tumbling(stream, "ts", "1 day").writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", scratch(spark, "state")).foreachBatch(keep).start()
    query.awaitTermination()
    last = query.lastProgress["batchId"]
    return spark.read.parquet(f"{out}/{last}").withColumn("window_start", c("window_start").cast("timestamp_ntz"))


@R.add("select count(*) as rows, true as refused from orders where o_orderkey <= 2000")
def range_messages(spark: SparkSession, d: str) -> DataFrame:
    """Data messages by row-id range: an overlapping one is refused; a range of ids read from the whole table taken in (O-245, O-247, O-275, O-276)."""
    rows, refused = _inbox(t(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    return rows.where("o_orderkey <= 2000").agg(F.count(F.lit(1)).alias("rows"), F.lit(refused).alias("refused"))


@R.add("select count(*) as rows, count(distinct o_orderkey) as ids, true as refused from orders")
def range_messages_whole(spark: SparkSession, d: str) -> DataFrame:
    """All rows that the messages brought (O-247)."""
    rows, refused = _inbox(t(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("o_orderkey").alias("ids"), F.lit(refused).alias("refused"))


def _inbox(x: DataFrame, key: str, messages: int = 8) -> tuple[DataFrame, bool]:
    """All rows with an id, sent in adjoining ranges between the least and the greatest id, and whether ranges that overlap or come again were refused."""
    spark = x.sparkSession
    box = E.RangeInbox(spark, scratch(spark, "inbox"))
    part = lambda a, b: box.take(x.where(c(key).between(a, b)), a, b)
    least, most = x.agg(F.min(key), F.max(key)).first()
    if least is None:
        return x.limit(0), True
    cuts = sorted({least + (most + 1 - least) * i // messages for i in range(messages)} | {most + 1})
    ranges = [(a, b - 1) for a, b in zip(cuts, cuts[1:])]
    taken = [part(a, b) for a, b in ranges]
    again = [part(a, b) for a, b in ranges] + [part(a, d) for (a, _), (_, d) in zip(ranges, ranges[1:])] + [part(b, b + 1) for _, b in ranges] + [part(least, most)]
    return box.rows(), all(taken) and not any(again)


@R.add("select s_suppkey, s_name from supplier where s_acctbal > 0")
def materialized_cursor(spark: SparkSession, d: str) -> DataFrame:
    """A result stored before it is fetched (O-39, O-253, O-295)."""
    register(spark, d, "supplier")
    return D.write_table(spark.sql("select s_suppkey, s_name from supplier where s_acctbal > 0"), scratch(spark, "cursor"))
