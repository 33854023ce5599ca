"""Queries of the general data-processing problems, with their SQL."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.instants import epoch_micros, epoch_seconds
from siltstone.operators.changefeed import apply_changes
from siltstone.operators.dedup import IdentifierIndex, split_copies
from siltstone.operators.diff import difference_fields, differences
from siltstone.operators.incremental import CommitLog, last_received, unread_objects
from siltstone.operators.quality import attribute_profiles, check_packs, check_reports
from siltstone.session import table
from siltstone.shared import scratch
from siltstone.sources.footers import load_reports, profile_columns

#: The command codes of requests.
PUT, DEL = 1, 2


def _pair_tables(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in ("msgcrpair", "msgcrmeta", "msgcrpairlist", "runlog")]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """obj_id of every object whose newest state no successful run has read: the output that a first run commits."""
    log = CommitLog(spark, scratch(spark, "commits"))
    log.take_unread(*_pair_tables(spark, d))
    return log.output().select("obj_id")


def p1_commits(spark: SparkSession, d: str) -> DataFrame:
    """run and obj_id of what two runs of one log commit.

    The first sees the lists received by the middle of the time, but for every seventh, which comes
    late; the second sees all and takes in only those that the first didn't.
    """
    pairs, meta, lists, runs = _pair_tables(spark, d)
    received = epoch_micros(lists, "received_at")
    least, most = lists.where("done").agg(F.min(received), F.max(received)).first()
    log = CommitLog(spark, scratch(spark, "commits"))
    middle = (least or 0) + ((most or 0) - (least or 0)) // 2
    log.take_unread(pairs, meta, lists.where((received <= F.lit(middle)) & (F.col("list_id") % 7 != 0)), runs)
    log.take_unread(pairs, meta, lists, runs)
    first, second = log.commits()
    out = [spark.read.parquet(c["path"]).where("taken").select(F.lit(c["run"] + 1).alias("run"), "obj_id") for c in (first, second)]
    return out[0].unionByName(out[1])


def p1_window(spark: SparkSession, d: str) -> DataFrame:
    """The id range, number of objects and upper limit of the next run."""
    tables = _pair_tables(spark, d)
    cut = last_received(tables[2])
    todo = unread_objects(*tables, limit=cut)
    return todo.agg(F.min("obj_id").alias("from_obj_id"), F.max("obj_id").alias("upto_obj_id"), F.count("obj_id").alias("n_objects"), F.lit(cut).cast("bigint").alias("cut_at_us"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Packs with impossible statistics and loads that changed."""
    return check_packs(table(spark, d, "msgibrcattrpack"))


def p2_profile(spark: SparkSession, d: str) -> DataFrame:
    """Profile of every attribute over its valid packs."""
    return attribute_profiles(table(spark, d, "msgibrcattrpack"))


def p2_columns(spark: SparkSession, d: str) -> DataFrame:
    """Profile of every column of the pack table itself, from footers and dictionaries."""
    found = profile_columns(spark, f"{d}/msgibrcattrpack.parquet", {"attr_name": "^[a-z]+_[a-z]+$"})
    return found.select("column_name", "rows", "nulls", "n_distinct", "low", "high", "violations")


def p2_loads(spark: SparkSession, d: str) -> DataFrame:
    """Loads of the orders, four adjoining ranges of their keys, whose columns changed against the load before, from the footers of their files alone."""
    orders = table(spark, d, "orders")
    most = orders.agg(F.max("o_orderkey")).first()[0] or 0
    parted = orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice")).alias("settled"), F.expr(f"o_orderkey * 4 div {most + 1}").alias("part"))
    paths = [scratch(spark, "load") for _ in range(4)]
    for i, path in enumerate(paths):
        own = parted.where(F.col("part") == i).drop("part")
        (own.withColumn("settled", F.coalesce("settled", F.lit(0.0))) if i == 2 else own).write.parquet(path)
    return check_reports(load_reports(spark, paths), most=None).select("kind", F.col("attr_id").alias("column_name"), "load_no")


def _split(spark: SparkSession, d: str, name: str, stamp: str | None) -> tuple[DataFrame, DataFrame]:
    index = IdentifierIndex(spark, scratch(spark, "index"))
    return split_copies(table(spark, d, name), index, "queryid", "delivery_id", stamp, "batch_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """delivery_id of every request and response that repeats a queryid."""
    with ThreadPool(2) as both:  # the tables are independent, so their jobs share the cluster
        parts = both.starmap(_split, [(spark, d, "msgriakasyncreq", "timestamp"), (spark, d, "msgriakasyncresp", None)])
    return parts[0][1].select("delivery_id").unionByName(parts[1][1].select("delivery_id"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """bucket, key and making delivery of every pair held at the end."""
    kept, _ = _split(spark, d, "msgriakasyncreq", "timestamp")
    time = F.coalesce(F.col("timestamp"), epoch_seconds(kept, "received_at"))
    order = [F.col("queryid").isNull(), F.col("queryid"), F.col("delivery_id")]
    return apply_changes(kept, ["bucket", "key"], time, order, F.col("cmdcode") == PUT, F.col("cmdcode") == DEL, ["delivery_id"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys on one side only and the fields that differ of the others."""
    a, b = table(spark, d, "msgcrpair_a"), table(spark, d, "msgcrpair_b")
    return difference_fields(differences(a, b, "key", ["obj_id", "value", "verify"]), "key")


QUERIES = {f.__name__: f for f in (p1_found, p1_commits, p1_window, p2_found, p2_profile, p2_columns, p2_loads, p3_found, p4_found, p5_found)}

_UNREAD = """
with lists as (select distinct list_id, received_at from msgcrpairlist where done),
pairs as (select distinct list_id, obj_id from msgcrpair where obj_id is not null),
meta as (select list_id, obj_id, max("timestamp") as ts from msgcrmeta group by all),
runs as (select * from runlog where done),
given as (select p.obj_id, coalesce(m.ts, -1e300) as ts,
   exists(select 1 from runs r where p.obj_id between r.from_obj_id and r.upto_obj_id and l.received_at > r.from_at and l.received_at <= r.cut_at) as seen
   from pairs p join lists l using (list_id) left join meta m on m.list_id = p.list_id and m.obj_id = p.obj_id),
newest as (select obj_id, max(ts) as ts from given group by 1),
unread as (select g.obj_id from given g join newest n on g.obj_id = n.obj_id and g.ts = n.ts group by 1 having not bool_or(g.seen))
"""

_PACKS = """
with newest as (select attr_id, load_no, pack_no, pack_type, no_obj, no_nulls, min_n, max_n from (
   select *, row_number() over (partition by attr_id, load_no, pack_no order by ver desc nulls last) as rn from msgibrcattrpack) where rn = 1),
checked as (select *, coalesce(no_obj between 1 and 65536 and no_nulls between 0 and no_obj and
   case when pack_type = 10 and no_nulls < no_obj then min_n is not null and max_n is not null and min_n <= max_n
        else min_n is null and max_n is null end, false) as valid from newest),
"""

ORACLE = {
    "p1_found": _UNREAD + "select obj_id from unread",
    "p1_commits": _UNREAD
    + """, middle as (select epoch_us(min(received_at)) + (epoch_us(max(received_at)) - epoch_us(min(received_at))) // 2 as us from lists),
parted as (select p.obj_id, coalesce(m.ts, -1e300) as ts, coalesce(epoch_us(l.received_at) <= (select us from middle) and l.list_id % 7 <> 0, false) as early,
   exists(select 1 from runs r where p.obj_id between r.from_obj_id and r.upto_obj_id and l.received_at > r.from_at and l.received_at <= r.cut_at) as seen
   from pairs p join lists l using (list_id) left join meta m on m.list_id = p.list_id and m.obj_id = p.obj_id),
tops as (select obj_id, early, max(ts) as ts from parted group by all),
states as (select t.obj_id, t.early, t.ts, bool_or(p.seen) as seen from tops t join parted p on p.obj_id = t.obj_id and p.early = t.early and p.ts = t.ts group by all)
select 1 as run, obj_id from states where early and not seen
union all select 2, s.obj_id from states s left join states e on e.early and e.obj_id = s.obj_id where not s.early and not s.seen and (e.ts is null or s.ts > e.ts)""",
    "p1_window": _UNREAD
    + "select min(obj_id) as from_obj_id, max(obj_id) as upto_obj_id, count(*) as n_objects, (select epoch_us(max(received_at)) from lists) as cut_at_us from unread",
    "p2_found": _PACKS
    + """loads as (select attr_id, load_no, sum(no_obj)::hugeint as n, sum(no_nulls)::hugeint as z, min(min_n)::hugeint as lo, max(max_n)::hugeint as hi from checked where valid group by 1, 2),
pairs as (select *, lag(n) over w as n0, lag(z) over w as z0, lag(lo) over w as lo0, lag(hi) over w as hi0 from loads window w as (partition by attr_id order by load_no))
select 'pack' as kind, attr_id, load_no, pack_no from checked where not valid
union all select 'load', attr_id, load_no, -1 from pairs where n0 is not null and (
   abs(z * n0 - z0 * n) * 10 > n * n0
   or (lo is not null and lo0 is not null and 2 * greatest(least(hi, hi0) - greatest(lo, lo0) + 1, 0) < greatest(hi - lo + 1, hi0 - lo0 + 1)))""",
    "p2_profile": _PACKS
    + """x as (select 1)
select attr_id, count(distinct load_no) as loads, count(*) filter (where valid) as packs, count(*) filter (where not valid) as bad_packs,
   (sum(no_obj) filter (where valid))::bigint as rows, (sum(no_nulls) filter (where valid))::bigint as nulls,
   min(min_n) filter (where valid) as min_n, max(max_n) filter (where valid) as max_n,
   round((sum(no_nulls) filter (where valid))::double / (sum(no_obj) filter (where valid))::double, 6) as null_share
from checked group by 1""",
    "p2_columns": " union all ".join(
        f"select '{c}' as column_name, count(*) as rows, count(*) - count({c}) as nulls, count(distinct {c}) as n_distinct, "
        + ", ".join(f"strftime({e}({c}), '%Y-%m-%d %H:%M:%S.%f') as {n}" if c == "loaded_at" else f"{e}({c})::varchar as {n}" for e, n in (("min", "low"), ("max", "high")))
        + ", "
        + ("(count(*) filter (where not regexp_matches(attr_name, '^[a-z]+_[a-z]+$')))::bigint" if c == "attr_name" else "null::bigint")
        + " as violations from msgibrcattrpack"
        for c in "table_id attr_id attr_name load_no pack_no pack_type no_obj no_nulls optimal_mode min_n max_n total_size data_full_byte_size ver loaded_at".split()
    ),
    "p2_loads": """with parted as (select *, o_orderkey * 4 // (max(o_orderkey) over () + 1) + 1 as load_no from orders),
v as (select load_no, unnest([{'c': 'o_orderkey', 'n': o_orderkey::double, 'i': true}, {'c': 'o_custkey', 'n': o_custkey::double, 'i': true},
   {'c': 'settled', 'n': case when o_orderstatus <> 'O' then o_totalprice when load_no = 3 then 0 end, 'i': false}]) as x from parted),
loads as (select x.c as c, load_no, count(*)::hugeint as n, (count(*) - count(x.n))::hugeint as z, min(case when x.i then x.n end)::hugeint as lo, max(case when x.i then x.n end)::hugeint as hi from v group by 1, 2),
pairs as (select *, lag(n) over w as n0, lag(z) over w as z0, lag(lo) over w as lo0, lag(hi) over w as hi0 from loads window w as (partition by c order by load_no))
select 'load' as kind, c as column_name, load_no::integer as load_no from pairs where n0 is not null and (abs(z * n0 - z0 * n) * 10 > n * n0
   or (lo is not null and lo0 is not null and 2 * greatest(least(hi, hi0) - greatest(lo, lo0) + 1, 0) < greatest(hi - lo + 1, hi0 - lo0 + 1)))""",
    "p3_found": """select delivery_id from (select delivery_id, row_number() over (partition by queryid order by "timestamp" nulls last, delivery_id) as rn from msgriakasyncreq where queryid is not null) where rn > 1
union all select delivery_id from (select delivery_id, row_number() over (partition by queryid order by delivery_id) as rn from msgriakasyncresp where queryid is not null) where rn > 1""",
    "p4_found": """with kept as (select * from (select *, row_number() over (partition by queryid order by "timestamp" nulls last, delivery_id) as rn from msgriakasyncreq) where rn = 1 or queryid is null),
acts as (select *, row_number() over (partition by bucket, key order by coalesce("timestamp", epoch_us(received_at) / 1e6) desc, queryid desc nulls first, delivery_id desc) as newest from kept where cmdcode in (1, 2))
select bucket, key, delivery_id from acts where newest = 1 and cmdcode = 1""",
    "p5_found": """with a as (select distinct key, obj_id, value, verify from msgcrpair_a), b as (select distinct key, obj_id, value, verify from msgcrpair_b)
select key, 'only_a' as field from a where not exists (select 1 from b where b.key is not distinct from a.key)
union all select key, 'only_b' from b where not exists (select 1 from a where b.key is not distinct from a.key)
union all select a.key, 'obj_id' from a join b on a.key is not distinct from b.key where a.obj_id is distinct from b.obj_id
union all select a.key, 'value' from a join b on a.key is not distinct from b.key where a.value is distinct from b.value
union all select a.key, 'verify' from a join b on a.key is not distinct from b.key where a.verify is distinct from b.verify""",
}
