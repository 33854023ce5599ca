"""Queries of scans, filters, joins, aggregation, sorting, set operations and statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.operators import aggregates as A
from siltstone.operators import dml as D
from siltstone.operators import fulltext as X
from siltstone.operators import joins as J
from siltstone.operators import predicates as P
from siltstone.operators import sorting as S
from siltstone.plans.registry import Registry
from siltstone.session import register, table
from siltstone.sources.tables import columns_of, number_rows

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
t = table
c = F.col


@R.add("""select c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_quantity), 4) as avg_quantity, count(distinct o_orderkey) as orders
from lineitem join orders on l_orderkey = o_orderkey join customer on c_custkey = o_custkey where o_orderdate between timestamp '1994-01-01' and timestamp '1997-12-31'
group by 1 having count(distinct o_orderkey) > 10 order by revenue desc limit 3""")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Filter, two joins, grouped and distinct aggregation, HAVING, top-k (O-1, O-2, O-72, O-94, O-70, O-131)."""
    orders = t(spark, d, "orders").where(c("o_orderdate").between(F.lit("1994-01-01").cast("timestamp_ntz"), F.lit("1997-12-31").cast("timestamp_ntz")))
    joined = t(spark, d, "lineitem").join(orders, c("l_orderkey") == c("o_orderkey")).join(t(spark, d, "customer"), c("c_custkey") == c("o_custkey"))
    grouped = joined.groupBy("c_mktsegment").agg(
        F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_quantity"), 4).alias("avg_quantity"), F.count_distinct("o_orderkey").alias("orders")
    )
    return S.top(grouped.where("orders > 10"), 3, c("revenue").desc())


@R.add("select l_orderkey, l_quantity from lineitem where l_shipdate >= timestamp '1998-06-01'")
def scan_prune(spark: SparkSession, d: str) -> DataFrame:
    """Two columns under a pushed-down filter (O-1, O-2, O-40)."""
    return t(spark, d, "lineitem").where(c("l_shipdate") >= F.lit("1998-06-01").cast("timestamp_ntz")).select("l_orderkey", "l_quantity")


@R.add("select c_custkey, 'fixed' as tag, c_acctbal * 2 + 1 as twice, 3 * 4 as folded, c_nationkey in (1, 2, 3) as listed from customer")
def project_columns(spark: SparkSession, d: str) -> DataFrame:
    """Physical, constant, folded, expression and IN-set columns (O-40 to O-45, O-48)."""
    return t(spark, d, "customer").select("c_custkey", F.lit("fixed").alias("tag"), (c("c_acctbal") * 2 + 1).alias("twice"), (F.lit(3) * 4).alias("folded"), c("c_nationkey").isin(1, 2, 3).alias("listed"))


@R.add("""select c_custkey, cast(round(c_acctbal) as integer) as i, try_cast(c_name as integer) as from_text, cast(c_custkey as varchar) as s, cast(c_acctbal as decimal(12,1)) as dec from customer""")
def cast_columns(spark: SparkSession, d: str) -> DataFrame:
    """Casts that give null instead of failing (O-47, O-237)."""
    return t(spark, d, "customer").select("c_custkey", F.round(c("c_acctbal")).cast("int").alias("i"), c("c_name").try_cast("int").alias("from_text"), c("c_custkey").cast("string").alias("s"), c("c_acctbal").cast("decimal(12,1)").alias("dec"))


@R.add("select c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') as segment from customer")
def column_default(spark: SparkSession, d: str) -> DataFrame:
    """DEFAULT(col) where a value is missing (O-50)."""
    return t(spark, d, "customer").select("c_custkey", F.coalesce(F.nullif(c("c_mktsegment"), F.lit("BUILDING")), F.lit("none")).alias("segment"))


@R.add("select l_orderkey, l_linenumber from lineitem where l_quantity > 45 and l_discount <= 0.02 and l_tax <> 0.03 and l_linenumber >= 2 and l_partkey < 1500")
def filter_compare(spark: SparkSession, d: str) -> DataFrame:
    """Six comparisons (O-51, O-60)."""
    return t(spark, d, "lineitem").where("l_quantity > 45 and l_discount <= 0.02 and l_tax <> 0.03 and l_linenumber >= 2 and l_partkey < 1500").select("l_orderkey", "l_linenumber")


@R.add("""with x as (select c_custkey, nullif(c_nationkey, 3) as a, nullif(c_nationkey, 5) as b from customer)
select c_custkey, a is not distinct from b as same, a is not distinct from null as gap from x""")
def filter_null_safe(spark: SparkSession, d: str) -> DataFrame:
    """<=> (O-52)."""
    x = t(spark, d, "customer").select("c_custkey", F.nullif(c("c_nationkey"), F.lit(3)).alias("a"), F.nullif(c("c_nationkey"), F.lit(5)).alias("b"))
    return x.select("c_custkey", c("a").eqNullSafe(c("b")).alias("same"), c("a").eqNullSafe(F.lit(None)).alias("gap"))


@R.add("select o_orderkey from orders where o_totalprice between 1000 and 50000 and o_custkey not between 100 and 1000")
def filter_between(spark: SparkSession, d: str) -> DataFrame:
    """BETWEEN and NOT BETWEEN (O-53)."""
    return t(spark, d, "orders").where(c("o_totalprice").between(1000, 50000) & ~c("o_custkey").between(100, 1000)).select("o_orderkey")


@R.add(r"""select p_partkey, p_name like '%a_e%' as a, p_type not like '%BRASS' as b, ('10%_' || p_brand) like '10|%|_%' escape '|' as e, lower(p_name) like '%red%' as f from part""")
def filter_like(spark: SparkSession, d: str) -> DataFrame:
    """LIKE with an escape character, NOT LIKE, without regard to case (O-54)."""
    return t(spark, d, "part").select(
        "p_partkey", P.like(c("p_name"), "%a_e%").alias("a"), (~P.like(c("p_type"), "%BRASS")).alias("b"),
        P.like(F.concat(F.lit("10%_"), c("p_brand")), "10|%|_%", "|").alias("e"), P.like(c("p_name"), "%RED%", fold=True).alias("f"),
    )


@R.add("""select o_orderkey, o_orderpriority in ('1-URGENT', '2-HIGH') as a, nullif(o_custkey % 7, 0) in (1, 2, null) as b, nullif(o_custkey % 7, 0) not in (1, null) as n from orders""")
def filter_in(spark: SparkSession, d: str) -> DataFrame:
    """IN and NOT IN, also with nulls in the list (O-45, O-55, O-56)."""
    k = F.nullif(c("o_custkey") % 7, F.lit(0))
    return t(spark, d, "orders").select("o_orderkey", c("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("a"), k.isin(1, 2, None).alias("b"), (~k.isin(1, None)).alias("n"))


@R.add("""select l_orderkey, l_linenumber, (l_linenumber = 1 and l_returnflag = 'A') or (l_linenumber = 2 and l_returnflag = 'N') as hit from lineitem""")
def filter_row_in(spark: SparkSession, d: str) -> DataFrame:
    """Row constructors in IN (O-57)."""
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", P.row_in([c("l_linenumber"), c("l_returnflag")], [(1, "A"), (2, "N")]).alias("hit"))


@R.add("""with x as (select c_custkey, nullif(c_nationkey, 3) > 5 as b from customer)
select c_custkey, b is null as u, b is not null as nn, b is true as t, b is not false as nf, isnull(b) as g from x""".replace("isnull(b)", "b is null"))
def filter_truth(spark: SparkSession, d: str) -> DataFrame:
    """IS [NOT] NULL, TRUE, FALSE, UNKNOWN (O-58, O-59, O-236)."""
    x = t(spark, d, "customer").select("c_custkey", (F.nullif(c("c_nationkey"), F.lit(3)) > 5).alias("b"))
    return x.select("c_custkey", P.is_unknown(c("b")).alias("u"), c("b").isNotNull().alias("nn"), F.expr("b is true").alias("t"), F.expr("b is not false").alias("nf"), F.isnull("b").alias("g"))


@R.add("""with x as (select c_custkey, nullif(c_nationkey, 3) > 5 as a, nullif(c_custkey % 4, 1) > 1 as b from customer)
select c_custkey, a and b as x_and, a or b as x_or, not a as x_not, a <> b as x_xor from x""")
def filter_three_valued(spark: SparkSession, d: str) -> DataFrame:
    """AND, OR, NOT, XOR with nulls (O-60, O-61)."""
    x = t(spark, d, "customer").select("c_custkey", (F.nullif(c("c_nationkey"), F.lit(3)) > 5).alias("a"), (F.nullif(c("c_custkey") % 4, F.lit(1)) > 1).alias("b"))
    return x.select("c_custkey", (c("a") & c("b")).alias("x_and"), (c("a") | c("b")).alias("x_or"), (~c("a")).alias("x_not"), P.xor(c("a"), c("b")).alias("x_xor"))


@R.add("""select o_orderkey from orders where (o_orderstatus = 'F' and o_totalprice > 100000) or (o_orderstatus = 'F' and o_orderpriority = '1-URGENT') or not (o_custkey > 5 or o_totalprice > 10)""")
def filter_tree(spark: SparkSession, d: str) -> DataFrame:
    """OR and AND trees with a common factor (O-65)."""
    f = c("o_orderstatus") == "F"
    return t(spark, d, "orders").where((f & (c("o_totalprice") > 100000)) | (f & (c("o_orderpriority") == "1-URGENT")) | ~((c("o_custkey") > 5) | (c("o_totalprice") > 10))).select("o_orderkey")


@R.add("select n_nationkey from nation where true and not (1 = 2) union all select n_nationkey from nation where 1 = 2")
def filter_constant(spark: SparkSession, d: str) -> DataFrame:
    """Constant predicates keep or empty a table (O-64)."""
    n = t(spark, d, "nation").select("n_nationkey")
    return n.where(F.lit(True) & ~(F.lit(1) == F.lit(2))).union(n.where(F.lit(1) == F.lit(2)))


@R.add("""select p_partkey, regexp_matches(p_name, '(?i)^[[:alpha:]]+ B') as a, regexp_matches(p_brand, '[[:digit:]]{2}$') as b from part""")
def filter_regexp(spark: SparkSession, d: str) -> DataFrame:
    """REGEXP with POSIX classes (O-62)."""
    from siltstone.functions.strings import regexp

    return t(spark, d, "part").select("p_partkey", regexp(c("p_name"), "^[[:alpha:]]+ B").alias("a"), regexp(c("p_brand"), "[[:digit:]]{2}$", fold=False).alias("b"))


@R.add("""select s_suppkey from supplier where s_acctbal > any (select c_acctbal from customer where c_nationkey = 4)
union all select s_suppkey from supplier where s_nationkey = any (select n_nationkey from nation where n_regionkey = 1)""")
def filter_any(spark: SparkSession, d: str) -> DataFrame:
    """> ANY and = ANY (O-66)."""
    s = t(spark, d, "supplier")
    a = P.compare_any(s, "s_acctbal", ">", t(spark, d, "customer").where("c_nationkey = 4"), "c_acctbal")
    b = P.compare_any(s, "s_nationkey", "=", t(spark, d, "nation").where("n_regionkey = 1"), "n_nationkey")
    return a.select("s_suppkey").union(b.select("s_suppkey"))


@R.add("""select s_suppkey, 1 as test from supplier where s_acctbal >= all (select c_acctbal from customer where c_nationkey = 4)
union all select s_suppkey, 2 from supplier where s_acctbal < all (select c_acctbal from customer where c_nationkey = 99)
union all select s_suppkey, 3 from supplier where s_acctbal > all (select nullif(c_acctbal, c_acctbal) from customer)
union all select s_suppkey, 4 from supplier where s_nationkey <> all (select n_nationkey from nation where n_regionkey = 1)""")
def filter_all(spark: SparkSession, d: str) -> DataFrame:
    """>= ALL, ALL of nothing, ALL with nulls, <> ALL (O-66)."""
    s, k = t(spark, d, "supplier"), t(spark, d, "customer")
    parts = [
        P.compare_all(s, "s_acctbal", ">=", k.where("c_nationkey = 4"), "c_acctbal"),
        P.compare_all(s, "s_acctbal", "<", k.where("c_nationkey = 99"), "c_acctbal"),
        P.compare_all(s, "s_acctbal", ">", k.select(F.nullif(c("c_acctbal"), c("c_acctbal")).alias("v")), "v"),
        P.compare_all(s, "s_nationkey", "<>", t(spark, d, "nation").where("n_regionkey = 1"), "n_nationkey"),
    ]
    return J.union_tables(*(p.select("s_suppkey", F.lit(i).alias("test")) for i, p in enumerate(parts, 1)))


@R.add("""select count(*) as n from documents where list_contains(regexp_extract_all(lower(text), '([\\p{L}\\p{N}_'']+)', 1), 'garden')
and not list_contains(regexp_extract_all(lower(text), '([\\p{L}\\p{N}_'']+)', 1), 'river')""")
def fulltext_boolean(spark: SparkSession, d: str) -> DataFrame:
    """MATCH … AGAINST in boolean mode (O-68, O-255)."""
    return t(spark, d, "documents").where(X.match_boolean(c("text"), "+garden -river")).agg(F.count(F.lit(1)).alias("n"))


@R.add("""with w as (select doc_id, unnest(regexp_extract_all(lower(text), '([\\p{L}\\p{N}_'']+)', 1)) as w from documents),
hits as (select doc_id, w, count(*) as tf from w where w in ('lantern', 'casino', 'bonus') group by 1, 2),
weight as (select w, ln((select count(text) from documents) / count(*)) as idf from hits group by 1 having count(*) * 2 <= (select count(text) from documents))
select doc_id, round(sum((1 + ln(tf)) * idf), 6) as score from hits join weight using (w) group by 1""")
def fulltext_relevance(spark: SparkSession, d: str) -> DataFrame:
    """MATCH … AGAINST in natural language (O-67)."""
    return X.relevance(t(spark, d, "documents"), "doc_id", "text", "lantern casino bonus")


@R.add("""select count(*) filter (where lower(lang) = 'en') as folded, count(*) filter (where lang = 'en') as exact, count(*) filter (where rtrim(lang || '  ') = 'en') as padded from documents""")
def filter_collation(spark: SparkSession, d: str) -> DataFrame:
    """Comparison without regard to case, byte by byte, and without trailing spaces (O-69, O-203)."""
    low, bare = F.collate(c("lang"), "UTF8_LCASE"), F.collate(F.concat(c("lang"), F.lit("  ")), "UTF8_BINARY_RTRIM")
    return t(spark, d, "documents").agg(F.count_if(low == "en").alias("folded"), F.count_if(c("lang") == "en").alias("exact"), F.count_if(bare == "en").alias("padded"))


@R.add("select c_nationkey, count(*) as n, round(avg(c_acctbal), 4) as mean from customer group by 1 having count(*) > 50 and avg(c_acctbal) > 4000")
def group_having(spark: SparkSession, d: str) -> DataFrame:
    """HAVING (O-70)."""
    g = t(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("m"))
    return g.where("n > 50 and m > 4000").select("c_nationkey", "n", F.round("m", 4).alias("mean"))


# joins


@R.add("""select a.l_orderkey, a.l_linenumber, b.l_quantity from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey = b.l_partkey and a.l_linenumber = b.l_linenumber""")
def join_inner_multi(spark: SparkSession, d: str) -> DataFrame:
    """Inner join on several keys (O-71 to O-73, O-80)."""
    a, b = t(spark, d, "lineitem"), t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", c("l_quantity"))
    return a.drop("l_quantity").join(b, ["l_orderkey", "l_partkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_quantity")


@R.add("select s_suppkey, n_name, r_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def join_mapped(spark: SparkSession, d: str) -> DataFrame:
    """Lookup tables whose size is checked before they are copied (O-75, O-90)."""
    s = t(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    nation = t(spark, d, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    return J.mapped(J.mapped(s, nation, ["n_nationkey"]), t(spark, d, "region"), ["r_regionkey"]).select("s_suppkey", "n_name", "r_name")


@R.add("""select o_orderpriority, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem join orders on l_orderkey = o_orderkey group by 1""")
def join_salted(spark: SparkSession, d: str) -> DataFrame:
    """A join whose keys may be hot, spread over salts (O-72, O-95)."""
    o = t(spark, d, "orders").select(c("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return J.salted(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), o, ["l_orderkey"]).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@R.add("select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 200000")
def join_left(spark: SparkSession, d: str) -> DataFrame:
    """LEFT JOIN with a condition in ON (O-77 to O-79)."""
    return t(spark, d, "customer").join(t(spark, d, "orders"), (c("c_custkey") == c("o_custkey")) & (c("o_totalprice") > 200000), "left").select("c_custkey", "o_orderkey")


@R.add("select c_custkey, o_orderkey from orders right join customer on c_custkey = o_custkey and o_orderstatus = 'P'")
def join_right(spark: SparkSession, d: str) -> DataFrame:
    """RIGHT JOIN (O-78)."""
    return t(spark, d, "orders").join(t(spark, d, "customer"), (c("c_custkey") == c("o_custkey")) & (c("o_orderstatus") == "P"), "right").select("c_custkey", "o_orderkey")


@R.add("""select a.k as a, b.k as b, x, y from (select c_nationkey as k, count(*) as x from customer where c_nationkey < 15 group by 1) a
full join (select s_nationkey as k, count(*) as y from supplier where s_nationkey > 10 group by 1) b on a.k = b.k""")
def join_full(spark: SparkSession, d: str) -> DataFrame:
    """FULL JOIN of derived tables (O-78, O-90)."""
    a = t(spark, d, "customer").where("c_nationkey < 15").groupBy(c("c_nationkey").alias("a")).agg(F.count(F.lit(1)).alias("x"))
    b = t(spark, d, "supplier").where("s_nationkey > 10").groupBy(c("s_nationkey").alias("b")).agg(F.count(F.lit(1)).alias("y"))
    return a.join(b, c("a") == c("b"), "full")


@R.add("select n_name, r_name from nation cross join region")
def join_cross(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of two tables proven to be small (O-81)."""
    return J.cross(t(spark, d, "nation"), t(spark, d, "region")).select("n_name", "r_name")


@R.add("select s_suppkey, (select count(*) from customer where c_acctbal < s_acctbal) as n_less from supplier")
def join_theta_count(spark: SparkSession, d: str) -> DataFrame:
    """A join on one inequality, reduced to counts without making pairs (O-74)."""
    return J.count_less(t(spark, d, "supplier"), "s_acctbal", t(spark, d, "customer"), "c_acctbal", 50.0).select("s_suppkey", "n_less")


@R.add("""select p_partkey, lo from part join (select unnest([900, 1000, 1100, 1400]) as lo, unnest([1000, 1050, 1500, 1420]) as hi) on lo <= p_retailprice and p_retailprice < hi""")
def join_range(spark: SparkSession, d: str) -> DataFrame:
    """Values between bounds, through buckets (O-74, O-76)."""
    ranges = spark.createDataFrame([(900, 1000), (1000, 1050), (1100, 1500), (1400, 1420)], "lo int, hi int")
    return J.range_join(t(spark, d, "part"), "p_retailprice", ranges, "lo", "hi", 100.0).select("p_partkey", "lo")


@R.add("select a.n_name as one, b.n_name as other from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
def join_self(spark: SparkSession, d: str) -> DataFrame:
    """Self join with a general condition beside the key (O-76, O-92)."""
    n = t(spark, d, "nation")
    return n.alias("a").join(n.alias("b"), (c("a.n_regionkey") == c("b.n_regionkey")) & (c("a.n_nationkey") < c("b.n_nationkey"))).select(c("a.n_name").alias("one"), c("b.n_name").alias("other"))


@R.add("select n_name, r_name from nation join region on n_regionkey = r_regionkey where r_regionkey > 0")
def join_natural(spark: SparkSession, d: str) -> DataFrame:
    """NATURAL JOIN in SQL (O-82)."""
    register(spark, d, "nation", "region")
    return spark.sql("select n_name, r_name from (select n_name, n_regionkey as k from nation) natural join (select r_name, r_regionkey as k from region) where k > 0")


@R.add("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000)")
def join_semi(spark: SparkSession, d: str) -> DataFrame:
    """IN (subquery) (O-85, O-91)."""
    return t(spark, d, "customer").join(t(spark, d, "orders").where("o_totalprice > 300000"), c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey")


@R.add("select c_custkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 250000 where o_orderkey is null")
def join_anti_null(spark: SparkSession, d: str) -> DataFrame:
    """LEFT JOIN … IS NULL (O-84)."""
    return J.anti_by_null(t(spark, d, "customer"), t(spark, d, "orders").where("o_totalprice > 250000"), c("c_custkey") == c("o_custkey")).select("c_custkey")


@R.add("""select c_custkey, 1 as test from customer where nullif(c_nationkey, 3) not in (select s_nationkey from supplier where s_nationkey < 10)
union all select c_custkey, 2 from customer where nullif(c_nationkey, 3) not in (select nullif(s_nationkey, 4) from supplier)
union all select c_custkey, 3 from customer where nullif(c_nationkey, 3) not in (select s_nationkey from supplier where s_nationkey < 0)""")
def join_not_in(spark: SparkSession, d: str) -> DataFrame:
    """NOT IN (subquery) with nulls on the left, among the values, and without values (O-86)."""
    k = t(spark, d, "customer").withColumn("k", F.nullif(c("c_nationkey"), F.lit(3)))
    s = t(spark, d, "supplier").select("s_nationkey", F.nullif(c("s_nationkey"), F.lit(4)).alias("g"))
    parts = [J.not_in(k, "k", s.where("s_nationkey < 10"), "s_nationkey"), J.not_in(k, "k", s, "g"), J.not_in(k, "k", s.where("s_nationkey < 0"), "s_nationkey")]
    return J.union_tables(*(p.select("c_custkey", F.lit(i).alias("test")) for i, p in enumerate(parts, 1)))


@R.add("""select c_custkey, exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P') as e from customer""")
def join_exists(spark: SparkSession, d: str) -> DataFrame:
    """EXISTS in the select list (O-46, O-87)."""
    register(spark, d, "customer", "orders")
    return spark.sql("select c_custkey, exists(select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P') as e from customer")


@R.add("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 100000)")
def join_not_exists(spark: SparkSession, d: str) -> DataFrame:
    """NOT EXISTS (O-87)."""
    return t(spark, d, "customer").join(t(spark, d, "orders").where("o_totalprice > 100000"), c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey")


@R.add("select p_partkey, (select max(l_quantity) from lineitem where l_partkey = p_partkey) as most from part where p_retailprice > (select avg(p_retailprice) from part)")
def subquery_scalar(spark: SparkSession, d: str) -> DataFrame:
    """Correlated and uncorrelated scalar subqueries (O-46, O-88, O-89)."""
    register(spark, d, "part", "lineitem")
    return spark.sql("select p_partkey, (select max(l_quantity) from lineitem where l_partkey = p_partkey) as most from part where p_retailprice > (select avg(p_retailprice) from part)")


# aggregation


@R.add("""select l_returnflag, l_linestatus, count(*) as n, count(nullif(l_linenumber, 1)) as n_some, round(sum(l_quantity), 2) as s, round(avg(l_extendedprice), 4) as m, min(l_shipdate) as first, max(l_partkey) as most
from lineitem group by 1, 2""")
def agg_basic(spark: SparkSession, d: str) -> DataFrame:
    """COUNT, SUM, AVG, MIN, MAX by groups (O-94 to O-100, O-124)."""
    return t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.nullif(c("l_linenumber"), F.lit(1))).alias("n_some"), F.round(F.sum("l_quantity"), 2).alias("s"),
        F.round(F.avg("l_extendedprice"), 4).alias("m"), F.min("l_shipdate").alias("first"), F.max("l_partkey").alias("most"),
    )


@R.add("select count(*) as n, round(sum(l_tax), 4) as s, min(l_quantity) as lo from lineitem where l_orderkey < 0 union all select count(*), round(sum(l_tax), 4), min(l_quantity) from lineitem")
def agg_global(spark: SparkSession, d: str) -> DataFrame:
    """Aggregates without groups, also over no rows (O-119)."""
    x = t(spark, d, "lineitem")
    parts = [F.count(F.lit(1)).alias("n"), F.round(F.sum("l_tax"), 4).alias("s"), F.min("l_quantity").alias("lo")]
    return x.where("l_orderkey < 0").agg(*parts).union(x.agg(*parts))


@R.add("select l_returnflag, count(distinct l_partkey) as n from lineitem group by 1")
def agg_count_distinct(spark: SparkSession, d: str) -> DataFrame:
    """COUNT(DISTINCT) by groups in two aggregations, so hot groups spread (O-101)."""
    return A.spread_distinct(t(spark, d, "lineitem"), ["l_returnflag"], "l_partkey")


@R.add("""with x as (select l_returnflag, nullif(l_linenumber, 2) as a, l_suppkey as b from lineitem)
select l_returnflag, count(distinct (a, b)) filter (where a is not null and b is not null) as n from x group by 1""")
def agg_count_distinct_multi(spark: SparkSession, d: str) -> DataFrame:
    """COUNT(DISTINCT a, b) (O-102)."""
    return t(spark, d, "lineitem").select("l_returnflag", F.nullif(c("l_linenumber"), F.lit(2)).alias("a"), c("l_suppkey").alias("b")).groupBy("l_returnflag").agg(A.count_distinct("a", "b").alias("n"))


@R.add("select l_returnflag, round(sum(distinct l_quantity), 2) as s, round(avg(distinct l_quantity), 4) as m, round(sum(distinct l_suppkey::varchar::double), 2) as text_sum from lineitem group by 1")
def agg_distinct_measures(spark: SparkSession, d: str) -> DataFrame:
    """SUM, AVG over distinct values, also of texts of numbers (O-103, O-104, O-238)."""
    from siltstone.functions.strings import number_prefix

    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.sum_distinct("l_quantity"), 2).alias("s"), F.expr("round(avg(distinct l_quantity), 4)").alias("m"), F.round(F.sum_distinct(number_prefix(c("l_suppkey").cast("string"))), 2).alias("text_sum")
    )


@R.add("""select l_linestatus, round(var_pop(l_quantity), 6) as vp, round(var_samp(l_quantity), 6) as vs, round(stddev_pop(l_quantity), 6) as sp, round(stddev_samp(l_quantity), 6) as ss from lineitem group by 1
union all select 'one', round(var_pop(r_regionkey), 6), var_samp(r_regionkey), stddev_pop(r_regionkey), stddev_samp(r_regionkey) from region where r_regionkey = 1
union all select 'no', var_pop(r_regionkey), var_samp(r_regionkey), stddev_pop(r_regionkey), stddev_samp(r_regionkey) from region where r_regionkey < 0""")
def agg_variance(spark: SparkSession, d: str) -> DataFrame:
    """Variances and deviations, of one row and of none (O-105 to O-109)."""
    m = lambda x: [F.round(F.var_pop(x), 6).alias("vp"), F.round(F.var_samp(x), 6).alias("vs"), F.round(F.stddev_pop(x), 6).alias("sp"), F.round(F.stddev_samp(x), 6).alias("ss")]
    r = t(spark, d, "region")
    many = t(spark, d, "lineitem").groupBy("l_linestatus").agg(*m("l_quantity"))
    one, no = r.where("r_regionkey = 1").agg(*m("r_regionkey")), r.where("r_regionkey < 0").agg(*m("r_regionkey"))
    return many.union(one.select(F.lit("one"), "*")).union(no.select(F.lit("no"), "*"))


@R.add("""select l_returnflag, bit_and(l_partkey) as a, bit_or(l_partkey) as o, bit_xor(l_partkey) as x, bit_or(try_cast(case when l_linenumber > 3 then l_suppkey::varchar else 'x' end as bigint)) as t from lineitem group by 1""")
def agg_bits(spark: SparkSession, d: str) -> DataFrame:
    """Bit aggregates, also over texts (O-110 to O-112)."""
    text = F.when(c("l_linenumber") > 3, c("l_suppkey").cast("string")).otherwise("x")
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(
        A.bit_aggregate("and", c("l_partkey")).alias("a"), A.bit_aggregate("or", c("l_partkey")).alias("o"), A.bit_aggregate("xor", c("l_partkey")).alias("x"), A.bit_aggregate("or", text).alias("t")
    )


@R.add("""select n_regionkey, string_agg(n_name, ',' order by n_name) as names, string_agg(n_name, '; ' order by n_nationkey) as by_key, left(string_agg(n_name, ',' order by n_name), 10) as cut from nation group by 1""")
def agg_group_concat(spark: SparkSession, d: str) -> DataFrame:
    """GROUP_CONCAT with order, separator and greatest length (O-113, O-114)."""
    return t(spark, d, "nation").groupBy("n_regionkey").agg(
        A.group_concat(c("n_name")).alias("names"), A.group_concat(c("n_name"), [c("n_nationkey")], "; ").alias("by_key"), A.group_concat(c("n_name"), most=10).alias("cut")
    )


@R.add("select distinct l_returnflag, l_linestatus, l_linenumber from lineitem")
def distinct_rows(spark: SparkSession, d: str) -> DataFrame:
    """SELECT DISTINCT (O-115)."""
    return t(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@R.add("""select r_name, n_name, round(sum(c_acctbal), 2) as balance, (grouping(r_name) + grouping(n_name))::integer as level from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)""")
def agg_rollup(spark: SparkSession, d: str) -> DataFrame:
    """WITH ROLLUP (O-116)."""
    x = t(spark, d, "customer").join(t(spark, d, "nation"), c("c_nationkey") == c("n_nationkey")).join(t(spark, d, "region"), c("n_regionkey") == c("r_regionkey"))
    return A.with_total(x, ["r_name", "n_name"], balance=F.round(F.sum("c_acctbal"), 2))


@R.add("select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)")
def agg_cube(spark: SparkSession, d: str) -> DataFrame:
    """CUBE (O-117)."""
    return t(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@R.add("select year(o_orderdate)::integer as y, o_custkey % 10 as k, count(*) as n from orders group by 1, 2")
def agg_by_expression(spark: SparkSession, d: str) -> DataFrame:
    """Groups by expressions (O-118)."""
    return t(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y"), (c("o_custkey") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@R.add("select n_regionkey, count(*) as n, true as from_group from nation group by 1")
def agg_any_value(spark: SparkSession, d: str) -> DataFrame:
    """A column that isn't grouped gives a value of some row of its group (O-120)."""
    g = t(spark, d, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"), F.any_value("n_name").alias("some"), F.collect_set("n_name").alias("names"))
    return g.select("n_regionkey", "n", F.array_contains("names", c("some")).alias("from_group"))


@R.add("select l_partkey, count(*) as n from lineitem group by 1 order by n desc, l_partkey limit 7 offset 3")
def agg_limit(spark: SparkSession, d: str) -> DataFrame:
    """LIMIT and OFFSET over groups (O-121)."""
    return S.top(t(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")), 7, c("n").desc(), c("l_partkey"), offset=3)


@R.add("select true as close_to_exact")
def agg_approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Approximate distinct counts, within 10 % of the exact one (O-122)."""
    return t(spark, d, "lineitem").agg((F.abs(F.approx_count_distinct("l_partkey", 0.02) / F.count_distinct("l_partkey") - 1) < 0.1).alias("close_to_exact"))


@R.add("""select 'c_custkey' as field_name, min(c_custkey)::varchar as min_value, max(c_custkey)::varchar as max_value, min(length(c_custkey::varchar))::integer as min_length, max(length(c_custkey::varchar))::integer as max_length,
count(*) filter (where c_custkey = 0) as empties_or_zeros, count(*) - count(c_custkey) as nulls, round(avg(c_custkey), 4) as avg_value, round(stddev_pop(c_custkey), 4) as std from customer
union all select 'c_name', min(c_name), max(c_name), min(length(c_name))::integer, max(length(c_name))::integer, count(*) filter (where c_name = ''), count(*) - count(c_name), round(avg(length(c_name)), 4), null from customer
union all select 'c_nationkey', min(c_nationkey)::varchar, max(c_nationkey)::varchar, min(length(c_nationkey::varchar))::integer, max(length(c_nationkey::varchar))::integer, count(*) filter (where c_nationkey = 0), count(*) - count(c_nationkey), round(avg(c_nationkey), 4), round(stddev_pop(c_nationkey), 4) from customer
union all select 'c_mktsegment', min(c_mktsegment), max(c_mktsegment), min(length(c_mktsegment))::integer, max(length(c_mktsegment))::integer, count(*) filter (where c_mktsegment = ''), count(*) - count(c_mktsegment), round(avg(length(c_mktsegment)), 4), null from customer""")
def profile_analyse(spark: SparkSession, d: str) -> DataFrame:
    """PROCEDURE ANALYSE (O-125, O-254)."""
    return A.analyse(t(spark, d, "customer").drop("c_acctbal"))


# sorting


@R.add("select o_orderkey, o_orderstatus, o_totalprice, row_number() over (order by o_orderstatus desc, o_totalprice, o_orderkey)::integer as place from orders where o_orderkey % 10 = 1")
def order_multi(spark: SparkSession, d: str) -> DataFrame:
    """ORDER BY several columns in both directions; the place makes the order part of the result (O-127 to O-130, O-136, O-137, O-139)."""
    return _placed(t(spark, d, "orders").where("o_orderkey % 10 = 1"))


@R.add("select o_orderkey, o_orderstatus, o_totalprice, row_number() over (order by o_orderstatus desc, o_totalprice, o_orderkey)::integer as place from orders")
def order_whole(spark: SparkSession, d: str) -> DataFrame:
    """The same over the whole table (O-127, O-129, O-137)."""
    return _placed(t(spark, d, "orders"))


def _placed(orders: DataFrame) -> DataFrame:
    x = orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return number_rows(x.orderBy(c("o_orderstatus").desc(), "o_totalprice", "o_orderkey"), "place", held=True).withColumn("place", c("place").cast("int"))


@R.add("select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber limit 25")
def top_k(spark: SparkSession, d: str) -> DataFrame:
    """Top-k (O-131, O-135)."""
    return S.top(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), 25, c("l_extendedprice").desc(), c("l_orderkey"), c("l_linenumber"))


@R.add("select * from (select c_custkey from customer order by c_acctbal nulls first, c_custkey limit 10 offset 20) union all select c_custkey from customer where false")
def limit_offset(spark: SparkSession, d: str) -> DataFrame:
    """LIMIT off, n and LIMIT 0 (O-132, O-133)."""
    x = t(spark, d, "customer")
    return S.top(x, 10, c("c_acctbal"), c("c_custkey"), offset=20).select("c_custkey").union(x.select("c_custkey").limit(0))


@R.add("select count(*) as found_rows from orders where o_totalprice > 100000")
def found_rows(spark: SparkSession, d: str) -> DataFrame:
    """FOUND_ROWS() (O-134)."""
    return S.found_rows(t(spark, d, "orders").where("o_totalprice > 100000"))


@R.add("select count(*) as rows, 4 as parts, true as even, true as ordered from orders")
def range_splitter(spark: SparkSession, d: str) -> DataFrame:
    """Split keys at quantiles: parts of about equal size in order (O-138, O-278)."""
    x = t(spark, d, "orders").select("o_totalprice")
    cuts = S.range_split(x, "o_totalprice", 4)
    g = x.groupBy(S.split_of(c("o_totalprice"), cuts).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    w = Window.orderBy("part")  # a row per part
    return g.withColumn("ok", F.coalesce(F.lag("hi").over(w) < c("lo"), F.lit(True))).agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).cast("int").alias("parts"), (F.max("n") < 1.1 * F.avg("n")).alias("even"), F.every("ok").alias("ordered")
    )


@R.add("select p_partkey from part order by lower(p_name), p_partkey limit 20")
def order_collated(spark: SparkSession, d: str) -> DataFrame:
    """ORDER BY under a collation (O-141)."""
    return S.top(t(spark, d, "part"), 20, F.collate(c("p_name"), "UTF8_LCASE"), c("p_partkey")).select("p_partkey")


# set operations


@R.add("select c_nationkey as k from customer union all select s_nationkey from supplier")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    """UNION ALL (O-143, O-20)."""
    return J.union_tables(t(spark, d, "customer").select(c("c_nationkey").alias("k")), t(spark, d, "supplier").select(c("s_nationkey").alias("k")))


@R.add("select * from (select c_nationkey as k from customer union select s_nationkey from supplier) order by k desc limit 9")
def union_distinct_limit(spark: SparkSession, d: str) -> DataFrame:
    """UNION with a trailing ORDER BY and LIMIT (O-142, O-144)."""
    return S.top(J.union_wide(t(spark, d, "customer").select(c("c_nationkey").alias("k")), t(spark, d, "supplier").select("s_nationkey"), distinct=True), 9, c("k").desc())


@R.add("select c_custkey::varchar as k, c_acctbal as v from customer union all select p_name, p_size from part")
def union_widen(spark: SparkSession, d: str) -> DataFrame:
    """UNION of unlike types (O-145)."""
    return J.union_wide(t(spark, d, "customer").select(c("c_custkey").alias("k"), c("c_acctbal").alias("v")), t(spark, d, "part").select("p_name", "p_size"))


@R.add("select o_custkey as k from orders intersect select c_custkey from customer where c_acctbal > 5000")
def intersect_rows(spark: SparkSession, d: str) -> DataFrame:
    """INTERSECT, an extension (O-146)."""
    return t(spark, d, "orders").select(c("o_custkey").alias("k")).intersect(t(spark, d, "customer").where("c_acctbal > 5000").select("c_custkey"))


@R.add("select c_custkey as k from customer except select o_custkey from orders where o_orderstatus = 'P'")
def except_rows(spark: SparkSession, d: str) -> DataFrame:
    """EXCEPT, an extension (O-146)."""
    return t(spark, d, "customer").select(c("c_custkey").alias("k")).exceptAll(t(spark, d, "orders").where("o_orderstatus = 'P'").select("o_custkey").distinct()).distinct()


@R.add("""select o_custkey, o_orderkey, row_number() over w as n, rank() over (partition by o_custkey order by o_orderstatus) as r, round(sum(o_totalprice) over (w rows between 2 preceding and current row), 2) as s, lag(o_orderkey) over w as before
from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""")
def window_frames(spark: SparkSession, d: str) -> DataFrame:
    """Ranks, frames and neighbours, an extension (§2.7)."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t(spark, d, "orders").select(
        "o_custkey", "o_orderkey", F.row_number().over(w).cast("bigint").alias("n"), F.rank().over(Window.partitionBy("o_custkey").orderBy("o_orderstatus")).cast("bigint").alias("r"),
        F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("s"), F.lag("o_orderkey").over(w).alias("before"),
    )


# statements


@R.add("""select c_custkey, c_acctbal from customer where c_custkey % 3 <> 0 union all select c_custkey, 0.5 from customer where c_custkey % 3 = 0 union all select c_custkey + 1000000, 0.5 from customer where c_custkey % 30 = 0""")
def dml_replace(spark: SparkSession, d: str) -> DataFrame:
    """REPLACE INTO (O-31)."""
    x = t(spark, d, "customer").select("c_custkey", "c_acctbal")
    new = x.where("c_custkey % 3 = 0").select("c_custkey", F.lit(0.5).alias("c_acctbal")).union(x.where("c_custkey % 30 = 0").select(c("c_custkey") + 1000000, F.lit(0.5)))
    return D.replace_into(x, new, ["c_custkey"])


@R.add("""select s_suppkey, s_name, case when s_suppkey % 2 = 0 then s_acctbal + 100 else s_acctbal end as s_acctbal from supplier union all select s_suppkey + 1000000, 'new', 100.0 from supplier where s_suppkey % 20 = 0""")
def dml_upsert(spark: SparkSession, d: str) -> DataFrame:
    """INSERT … ON DUPLICATE KEY UPDATE (O-32)."""
    x = t(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    new = x.where("s_suppkey % 2 = 0").select("s_suppkey", F.lit("new").alias("s_name"), F.lit(100.0).alias("s_acctbal"))
    new = new.union(x.where("s_suppkey % 20 = 0").select(c("s_suppkey") + 1000000, F.lit("new"), F.lit(100.0)))
    return D.upsert(x, new, ["s_suppkey"], {"s_acctbal": c("t.s_acctbal") + c("n.s_acctbal")})


@R.add("""select s_suppkey, case when s_nationkey in (select n_nationkey from nation where n_regionkey = 2) then s_acctbal * 2 when s_acctbal < 0 then 0 else s_acctbal end as s_acctbal from supplier""")
def dml_update(spark: SparkSession, d: str) -> DataFrame:
    """UPDATE and multi-table UPDATE (O-33)."""
    x = t(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    asia = t(spark, d, "nation").where("n_regionkey = 2").select(c("n_nationkey").alias("s_nationkey"))
    rest = D.update(x, (c("s_acctbal") < 0) & ~c("s_nationkey").isin([r[0] for r in asia.collect()]), {"s_acctbal": F.lit(0.0)})
    return D.update_from(rest, asia, ["s_nationkey"], {"s_acctbal": c("t.s_acctbal") * 2}).select("s_suppkey", "s_acctbal")


@R.add("""select l_orderkey, l_linenumber from lineitem where not (l_quantity > 20) and l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')""")
def dml_delete(spark: SparkSession, d: str) -> DataFrame:
    """DELETE and multi-table DELETE (O-34, O-270)."""
    x = D.delete(t(spark, d, "lineitem"), c("l_quantity") > 20)
    return D.delete_using(x, t(spark, d, "orders").where("o_orderstatus = 'F'").select(c("o_orderkey").alias("l_orderkey")), ["l_orderkey"]).select("l_orderkey", "l_linenumber")


@R.add("""select c_custkey from customer where c_custkey not in (select c_custkey from customer where c_nationkey < 12 order by c_acctbal desc, c_custkey limit 40)""")
def dml_delete_limit(spark: SparkSession, d: str) -> DataFrame:
    """DELETE … ORDER BY … LIMIT (O-34)."""
    x = t(spark, d, "customer")
    return D.delete_limit(x, c("c_nationkey") < 12, [c("c_acctbal").desc(), c("c_custkey")], 40, ["c_custkey"]).select("c_custkey")


@R.add("select r_regionkey, r_name from region where false union all select r_regionkey, r_name from region")
def dml_truncate_insert(spark: SparkSession, d: str) -> DataFrame:
    """TRUNCATE, then INSERT … SELECT (O-30, O-35)."""
    x = t(spark, d, "region").select("r_regionkey", "r_name")
    return D.truncate(x).unionByName(x)


@R.add("select n_regionkey as k, count(*) as n from nation group by 1")
def view_query(spark: SparkSession, d: str) -> DataFrame:
    """A query through a view over a view (O-285, O-286)."""
    register(spark, d, "nation")
    spark.sql("create or replace temporary view nations_by_region as select n_regionkey as k, count(*) as n from nation group by 1")
    return spark.sql("select k, n from nations_by_region")


@R.add("select o_orderkey from orders where o_totalprice > 250000 and o_orderpriority = '1-URGENT'")
def prepared_query(spark: SparkSession, d: str) -> DataFrame:
    """A prepared statement with parameters (O-257, O-14)."""
    return spark.sql("select o_orderkey from {orders} where o_totalprice > :least and o_orderpriority = :priority", {"least": 250000, "priority": "1-URGENT"}, orders=t(spark, d, "orders"))


@R.add("""select 'region' as table_name, 1 as ordinal_position, 'r_regionkey' as column_name, 'int' as data_type union all select 'region', 2, 'r_name', 'string'""")
def information_schema(spark: SparkSession, d: str) -> DataFrame:
    """Columns of views (O-23)."""
    register(spark, d, "region")
    return columns_of(spark, ["region"])


@R.add("select 1 as one, min(7) as seven")
def no_table(spark: SparkSession, d: str) -> DataFrame:
    """SELECT without a table (O-25)."""
    return spark.sql("select 1 as one, min(7) as seven")


@R.add("select count(*) as rows, count(*) as ids, 1::bigint as first, count(*) as last from customer")
def auto_increment(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive numbers (O-289)."""
    x = number_rows(t(spark, d, "customer").repartition(7), "id")
    return x.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"), F.min("id").alias("first"), F.max("id").alias("last"))
