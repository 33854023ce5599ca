"""Queries over whole tables, and what only shows on them."""

import datetime
import os
import subprocess
import sys
from decimal import Decimal as D
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pyspark
import pytest
from pyspark.sql import functions as F

from siltstone.operators import joins
from siltstone.operators import knowledge as K
from siltstone.operators.dedup import IdentifierIndex, split_copies
from siltstone.operators.incremental import CommitLog
from siltstone.plans import relational, storage
from siltstone.shared import own_folder, scratch
from siltstone.sources import tables
from siltstone.sources.footers import profile_columns
from siltstone.sources.tables import number_rows, plan_text

c = F.col
ROOT = Path(__file__).resolve().parents[1]
DAY, AT = datetime.date(2001, 2, 3), datetime.datetime(2001, 2, 3, 4, 5, 6, 789000)


@pytest.fixture
def apart(spark):
    """Partitions of a shuffle stay as many as they are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_numbers_of_a_sort_in_several_partitions(spark, apart):
    """Ranges are sampled anew in each run, so numbers had gaps and came twice."""
    x = spark.range(150_000, numPartitions=8).select(((c("id") * 7919) % 150_001).alias("k")).orderBy(c("k").desc())
    n = number_rows(x, "place", held=True)
    assert n.agg(F.count_distinct("place"), F.min("place"), F.max("place")).first()[:] == (150_000, 1, 150_000)
    keys = [r["k"] for r in n.orderBy("place").collect()]
    assert keys == sorted(keys, reverse=True)


def test_order_whole(spark, apart, small):
    orders = spark.read.parquet(f"{small}/orders.parquet")
    got = relational.order_whole(spark, small).orderBy("place").collect()
    want = sorted(orders.select("o_orderkey", "o_orderstatus", "o_totalprice").collect(), key=lambda r: ([-ord(x) for x in r[1]], r[2], r[0]))
    assert [r["place"] for r in got] == list(range(1, orders.count() + 1))
    assert [tuple(r)[:3] for r in got] == [tuple(r) for r in want]


def test_messages_bring_the_whole_table(spark, small, monkeypatch):
    """Ids beyond any fixed bound come in, once each."""
    boxes = []
    made = storage.E.RangeInbox
    monkeypatch.setattr(storage.E, "RangeInbox", lambda *a: boxes.append(made(*a)) or boxes[-1])
    orders = spark.read.parquet(f"{small}/orders.parquet").withColumn("o_orderkey", c("o_orderkey") * 7 - 3000)
    monkeypatch.setattr(storage, "t", lambda *a: orders)
    got = storage.range_messages(spark, small).first()
    assert (got["rows"], got["refused"]) == (orders.where("o_orderkey <= 2000").count(), True)
    assert sorted(r[0] for r in boxes[0].rows().collect()) == sorted(r[0] for r in orders.select("o_orderkey").collect())
    assert storage.range_messages_whole(spark, small).first()["rows"] == orders.count()
    for few in (orders.limit(0), orders.limit(1)):
        rows, refused = storage._inbox(few.select("o_orderkey"), "o_orderkey")
        assert (rows.count(), refused) == (few.count(), True)


def test_runs_of_a_backlog_are_merged(spark):
    rows = spark.range(400).select((c("id") % 150).alias("k"), c("id").alias("n"), (400 - c("id")).cast("double").alias("at"), (c("id") % 20).alias("b"))
    index = IdentifierIndex(spark, scratch(spark, "merged"))
    kept, dropped = split_copies(rows, index, "k", "n", "at", "b")
    assert len(index._state()["runs"]) == 1 and len(index._state()["batches"]) == 2
    best = {}
    for k, n, at, _ in rows.collect():
        best[k] = min(best.get(k, (at, n)), (at, n))
    assert {r["n"] for r in kept.collect()} == {n for _, n in best.values()}
    assert dropped.count() == 400 - len(best)


def test_late_lists_are_not_skipped(spark):
    """A list without received_at, one that becomes complete and one that arrives at or below the watermark, after a first run."""
    at = datetime.datetime
    pairs = lambda *x: spark.createDataFrame(x, "list_id bigint, obj_id bigint")
    meta = lambda *x: spark.createDataFrame(x, "list_id bigint, obj_id bigint, timestamp double")
    lists = lambda *x: spark.createDataFrame(x, "list_id bigint, done boolean, received_at timestamp_ntz")
    runs = spark.createDataFrame([], "from_at timestamp_ntz, cut_at timestamp_ntz, from_obj_id bigint, upto_obj_id bigint, done boolean")
    log = CommitLog(spark, scratch(spark, "late"))
    first = [(1, True, at(2024, 1, 5))], (1, 10), (1, 10, 1.0)
    log.take_unread(pairs(first[1]), meta(first[2]), lists(*first[0], (2, False, at(2024, 1, 3))), runs)
    later = lists(*first[0], (2, True, at(2024, 1, 3)), (3, True, None), (4, True, at(2024, 1, 5)), (5, True, at(2024, 1, 1)))
    held = pairs((1, 10), (2, 20), (3, 30), (4, 40), (5, 10)), meta((1, 10, 1.0), (2, 20, 1.0), (4, 40, 2.0), (5, 10, 0.5))
    entry = log.take_unread(*held, later, runs)
    assert {r[0] for r in spark.read.parquet(entry["path"]).collect()} == {20, 30, 40}
    assert spark.read.parquet(log.take_unread(*held, later, runs)["path"]).count() == 0


def test_prefix_beyond_the_character_map(spark):
    texts = spark.createDataFrame([(1, "a" * 70 + "b"), (2, "b" * 80), (3, "a" * 10)], "p int, s string")
    maps = K.character_map(texts, c("p"), "s")
    assert [r[0] for r in K.may_be_like(maps, "a" * 70).collect()] == [1]
    assert [r[0] for r in K.may_be_like(maps, "b" * 3).collect()] == [2]


def test_truncated_extrema_are_scanned(spark, tmp_path):
    """A footer whose extrema are cut and marked so."""
    path = tmp_path / "x.parquet"
    pq.write_table(pa.table({"s": ["mmmm", "zzzz"]}), path, use_dictionary=False)
    data = path.read_bytes()
    at = len(data) - 8 - int.from_bytes(data[-8:-4], "little")
    assert data[at:].count(b"\x11\x11\x00") == 1 and b"mmmm" in data[at:]
    path.write_bytes(data[:at] + data[at:].replace(b"\x11\x11\x00", b"\x12\x12\x00").replace(b"mmmm", b"mmaa"))
    got = profile_columns(spark, str(path)).first()
    assert (got["low"], got["high"], got["from_footer"]) == ("mmmm", "zzzz", 0)


def test_salted_repeats_only_the_lookup_of_hot_keys(spark):
    """The whole lookup was repeated, and broadcast by its size before that, which ended the driver."""
    facts = spark.range(3000).select(F.when(c("id") % 3 == 0, 7).when(c("id") % 50 != 1, c("id")).alias("k"), c("id").alias("v"))
    lookup = spark.range(2000).select(c("id").alias("k"), (c("id") * 2).alias("w")).unionByName(spark.createDataFrame([(7, -1), (None, -2)], "k bigint, w bigint"))
    assert "Generate" not in plan_text(joins.salted(facts, lookup, ["k"]))
    for how in ("inner", "left"):
        want = sorted(facts.join(lookup, "k", how).collect(), key=str)
        for hot in (1, 900, 5000):
            got = joins.salted(facts, lookup, ["k"], how, hot=hot)
            assert got.columns == ["k", "v", "w"] and sorted(got.collect(), key=str) == want
        assert "SortMergeJoin" in plan_text(joins.salted(facts, lookup, ["k"], how, hot=900))


def suppliers(folder):
    pq.write_table(pa.table({"s_suppkey": range(300), "s_name": [f"s{i}" for i in range(300)], "s_acctbal": [i / 4 for i in range(300)]}), folder / "supplier.parquet", row_group_size=100)


def test_embedded_database_is_reached_by_the_driver(spark, tmp_path, monkeypatch):
    """Executors that are other processes found an empty database of their own."""
    monkeypatch.setattr(tables, "in_reach", lambda *a: False)
    x = spark.createDataFrame([(1, "a''b", 1.5, D("1.25"), DAY, AT, True), (2, None, None, None, None, None, None), (2, "", -0.0, D("-7.00"), DAY, AT, False)], "id bigint, s string, d double, m decimal(9,2), day date, at timestamp_ntz, b boolean")
    place = {"url": f"jdbc:derby:{own_folder()}/db;create=true", "table": "t"}
    tables.append_blocks(x, size=2, **place)
    tables.append_blocks(x.limit(0), **place)
    tables.append_blocks(x.where("id = 1"), **place)
    remote = tables.remote_table(spark, **place, split="id", bounds=(0, 1), parts=4)
    assert remote.inputFiles()  # rows of the working table, which any executor reads
    got = spark.read.format("jdbc").options(**tables.jdbc_options(**place)).load()
    for y in (remote, tables.fetched(got, size=3, **place)):
        assert sorted(y.select(*(c(n).alias(n.lower()) for n in y.columns)).withColumn("at", c("at").cast("timestamp_ntz")).collect(), key=str) == sorted([*x.collect(), *x.where("id = 1").collect()], key=str)
    with pytest.raises(ValueError):
        tables.append_blocks(x.select(F.array("id").alias("nested")), **place)
    suppliers(tmp_path)
    assert sorted(map(tuple, storage.io_jdbc(spark, str(tmp_path)).collect())) == [(i, f"s{i}", i / 4) for i in range(11, 300)]


def test_a_database_of_the_driver_from_other_processes(tmp_path):
    """The whole query with executors in processes of their own."""
    suppliers(tmp_path)
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():  # executors log to work in Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    code = f"""
from siltstone.plans.storage import io_jdbc
from siltstone.session import build_session
spark = build_session("local-cluster[2,1,1024]", spark__checkpoint__dir="file://{tmp_path}/shared", spark__executor__memory="512m", spark__driver__host="127.0.0.1", spark__sql__warehouse__dir="{tmp_path}/warehouse")
print("rows", *sorted(r["id"] for r in io_jdbc(spark, "{tmp_path}").collect()))
spark.stop()
"""
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYTHONPATH": str(ROOT), "PYSPARK_PYTHON": sys.executable, "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    said = [x.split() for x in done.stdout.splitlines() if x.startswith("rows")]
    assert said, done.stderr[-1500:]
    assert said[0][1:] == [str(i) for i in range(11, 300)]
