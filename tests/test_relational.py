"""Operators at their edges: nulls, empty tables, clashing names, refusals."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators import aggregates as A
from siltstone.operators import dml as D
from siltstone.operators import fulltext as X
from siltstone.operators import joins as J
from siltstone.operators import knowledge as K
from siltstone.operators import predicates as P
from siltstone.operators import sorting as S
from siltstone.shared import materialize, scratch, shared_folder
from siltstone.sources import delimited as L
from siltstone.sources import tables as B

c = F.col


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def ab(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (None, "x"), (3, "y"), (3, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (3, "q"), (None, "r")], "k int, w string")
    return a, b


def test_not_in(spark, ab):
    a, b = ab
    assert rows(J.not_in(a.withColumn("v_", F.lit(1)), "k", b, "k")) == []
    assert rows(J.not_in(a, "k", b.where("k = 1"), "k")) == [(2, None), (3, "y"), (3, "y")]
    assert rows(J.not_in(a, "k", b.limit(0), "k")) == rows(a)


def test_any_all_of_nothing_and_nulls(spark, ab):
    a, b = ab
    assert P.compare_any(a, "k", "<", b.limit(0), "k").count() == 0
    assert P.compare_all(a, "k", "<", b.limit(0), "k").count() == 5
    assert P.compare_all(a, "k", ">=", b, "k").count() == 0
    assert rows(P.compare_any(a, "k", "<>", b.where("k = 1"), "k").select("k")) == [(2,), (3,), (3,)]


def test_joins_keep_clashing_columns(spark, ab):
    a, b = ab
    a = a.withColumns({n: F.lit(0) for n in ("salt", "bucket", "mark", "n", "gaps")})
    assert J.salted(a, b, ["k"], "left").columns == [*a.columns, "w"]
    assert rows(J.salted(a, b, ["k"]).select("k", "w")) == [(1, "p"), (3, "q"), (3, "q")]
    assert rows(J.mapped(a, b, ["k"], most=1).select("k", "w")) == rows(J.mapped(a, b, ["k"]).select("k", "w"))
    got = J.count_less(a, "k", b, "k", 1.0)
    assert sorted((r["k"] or 0, r["n_less"]) for r in got.collect()) == [(0, 0), (1, 0), (2, 1), (3, 1), (3, 1)]
    ranges = spark.createDataFrame([(1, 3), (3, 3), (None, 9), (-5, 2)], "lo int, hi int")
    assert rows(J.range_join(a, "k", ranges, "lo", "hi", 2.0).select("k", "lo")) == [(1, -5), (1, 1), (2, 1)]


def test_refusals(spark, ab):
    a, b = ab
    with pytest.raises(ValueError):
        J.cross(a, b, most=14)
    assert J.cross(a, b.withColumnRenamed("k", "k2"), most=15).count() == 15
    with pytest.raises(ValueError):
        J.union_tables(a, b)
    with pytest.raises(ValueError):
        B.guard(a.crossJoin(a), 1)
    with pytest.raises(ValueError):
        B.jdbc_options("jdbc:x:y", "t", split="id")


def test_group_concat_and_profile(spark, ab):
    a, _ = ab
    assert rows(a.groupBy("k").agg(A.group_concat(c("v"), separator="|").alias("g"))) == [(1, "x"), (2, None), (3, "y|y"), (None, "x")]
    got = {r["field_name"]: r for r in A.analyse(a.withColumn("nested", F.array(F.lit(1)))).collect()}
    assert set(got) == {"k", "v"} and got["k"]["nulls"] == 1 and got["v"]["max_length"] == 1
    assert A.analyse(a.limit(0)).count() == 2
    assert rows(A.spread_distinct(a, ["v"], "k")) == [("x", 1), ("y", 1), (None, 1)]
    assert rows(a.agg(A.bit_aggregate("xor", F.lit("3.6")), A.bit_aggregate("and", F.lit("z")))) == [(4, None)]


def test_statements(spark, ab):
    a, b = ab
    target = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    new = spark.createDataFrame([(1, "c", 1), (1, "d", 2), (None, "e", 1)], "k int, v string, n int")
    assert rows(D.last_rows(new, ["k"], ["n"])) == [(1, "d", 2), (None, "e", 1)]
    assert rows(D.replace_into(target, new, ["k"], ["n"])) == [(1, "d"), (None, "e")]
    assert rows(D.upsert(target, spark.createDataFrame([(None, "z"), (5, "y")], "k int, v string"), ["k"], {"v": F.concat("t.v", "n.v")})) == [(1, "a"), (5, "y"), (None, "bz")]
    assert rows(D.update(target, c("k") == 1, {"v": F.lit("q")})) == [(1, "q"), (None, "b")]
    assert rows(D.delete(target, c("k") == 1)) == [(None, "b")]
    assert rows(D.delete_using(target, target.where("k is null"), ["k"])) == [(1, "a")]
    assert D.truncate(target).count() == 0


def test_fulltext(spark):
    d = spark.createDataFrame([(1, "Alpha is a Database, it's fast"), (2, "no-sql store"), (3, None), (4, "")], "id int, t string")
    hit = lambda q: [r[0] for r in d.where(X.match_boolean(c("t"), q)).select("id").collect()]
    assert hit("+alpha -store") == [1] and hit("data*") == [1] and hit("store fast") == [1, 2] and hit("") == [] and hit("-alpha") == [] and hit("it's") == [1]
    assert [r["id"] for r in X.relevance(d, "id", "t", "store").collect()] == [2]


def test_intervals_and_packs(spark):
    i = spark.createDataFrame([(1, 3), (4, 6), (10, 12), (2, 2), (None, 5), (9, 8)], "l bigint, h bigint")
    merged = K.merge_intervals(i, "l", "h")
    assert rows(merged) == [(1, 6), (10, 12)]
    assert rows(K.remove_interval(merged, "l", "h", (3, 10))) == [(1, 2), (11, 12)]
    assert rows(K.remove_interval(merged, "l", "h", (2, 4))) == [(1, 1), (10, 12), (5, 6)]
    packs = spark.createDataFrame([(1, 5, 0, 9), (6, 9, 0, 9), (6, 9, 1, 9), (None, None, 9, 9)], "min_n int, max_n int, no_nulls int, no_obj int")
    verdict = lambda op, v: [r[0] for r in packs.select(K.rough_check(op, v, c("min_n"), c("max_n"), c("no_nulls"), c("no_obj"))).collect()]
    assert verdict(">", 5) == ["none", "all", "some", "none"]
    assert verdict("=", 5) == ["some", "none", "none", "none"]
    assert verdict("between", (1, 7)) == ["all", "some", "some", "none"]
    assert verdict("<>", 100) == ["all", "all", "some", "none"]


def test_interval_sets_against_brute_force(spark):
    import random

    rnd = random.Random(2)
    data = [(rnd.choice(["a", None]), low, low + rnd.randrange(-1, 12)) for low in (rnd.randrange(1200) for _ in range(250))]
    want = []
    for g in ("a", None):
        points = sorted({x for k, low, high in data if k == g for x in range(low, high + 1)})
        for x in points:
            if want and want[-1][0] == g and want[-1][2] == x - 1:
                want[-1][2] = x
            else:
                want.append([g, x, x])
    got = K.merge_intervals(spark.createDataFrame(data, "g string, l bigint, h bigint"), "l", "h", ["g"], parts=7)
    assert rows(got) == sorted((tuple(x) for x in want), key=repr)


def test_range_split(spark):
    df = spark.range(1000).withColumn("k", c("id") % 10)
    cuts = S.range_split(df, "k", 4)
    sizes = [r[1] for r in sorted(df.groupBy(S.split_of(c("k"), cuts).alias("p")).count().collect())]
    assert len(sizes) == 4 and sum(sizes) == 1000
    assert S.range_split(df.limit(0), "k", 4) == []


def test_delimited(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a;"b"\\', None), (None, "", b"\x01\xff"), (3, "line", b"")], "k int, s string, b binary")
    L.export(df, str(tmp_path / "x"))
    schema = T.StructType.fromDDL("k int, s string, b string")
    back, errors = L.split_errors(L.load(spark, str(tmp_path / "x"), schema))
    assert rows(back) == [(1, 'a;"b"\\', None), (3, "line", ""), (None, "", "01FF")] and errors.count() == 0
    (tmp_path / "y").write_text("1|a\nzz|b\n3\n")
    fmt = L.TextFormat(delimiter="|")
    good, bad = L.split_errors(L.load(spark, str(tmp_path / "y"), T.StructType.fromDDL("k int, s string"), fmt))
    assert rows(good) == [(1, "a")] and {r[0] for r in bad.collect()} == {"zz|b", "3"}
    L.dump_value(spark.range(1).select(F.lit("raw")), str(tmp_path / "d"))
    assert (tmp_path / "d").read_text() == "raw"
    with pytest.raises(ValueError):
        L.dump_value(spark.range(2), str(tmp_path / "d"))


def test_binary_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, 2**62 + 1, 0.5), (None, None, None)], "a int, b bigint, f double")
    L.write_binary(df.coalesce(1), str(tmp_path / "b"))
    assert rows(L.read_binary(spark, str(tmp_path / "b"), df.schema)) == rows(df)


def test_tables(spark, tmp_path):
    df = spark.range(10).repartition(3)
    assert sorted(r["n"] for r in B.number_rows(df, "n", 5).collect()) == list(range(5, 15))
    assert B.number_rows(df.limit(0), "n").count() == 0
    assert [len(b) for b in B.blocks(spark.range(5), 2)] == [2, 2, 1, 0]
    B.backup({"t": df}, str(tmp_path / "s"))
    assert B.restore(spark, str(tmp_path / "s"))["t"].count() == 10
    spark.range(3).write.mode("append").parquet(str(tmp_path / "s" / "t"))
    with pytest.raises(ValueError):
        B.restore(spark, str(tmp_path / "s"))
    S.sorted_load(df, str(tmp_path / "o"), "id", files=3)
    assert S.order_violations(spark.read.parquet(str(tmp_path / "o")), "id").count() == 0
    df.write.parquet(str(tmp_path / "u"))
    assert S.order_violations(spark.read.parquet(str(tmp_path / "u")), "id").count() > 0


def test_working_tables(spark):
    assert scratch(spark, "x").startswith(shared_folder(spark))
    assert materialize(spark.range(3), "x").count() == 3
    assert materialize(spark.range(0), "x").count() == 0


def test_plans(spark, small):
    """Filters and columns reach the scan; a lookup is copied only as it is small."""
    df = spark.read.parquet(f"{small}/lineitem.parquet")
    text = B.plan_text(df.where("l_quantity > 45").select("l_orderkey"))
    assert "GreaterThan(l_quantity,45" in text and "l_extendedprice" not in text
    lookup = spark.read.parquet(f"{small}/orders.parquet").select(c("o_orderkey").alias("l_orderkey"), "o_custkey")
    assert "BroadcastHashJoin" in B.plan_text(J.mapped(df, lookup, ["l_orderkey"]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in B.plan_text(J.mapped(df, lookup, ["l_orderkey"], most=10))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
