"""The general problems: nulls, repeated rows, ties, empty tables, hot keys, failures."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siltstone.operators.changefeed import apply_changes
from siltstone.operators.dedup import IdentifierIndex, split_copies
from siltstone.operators.diff import difference_fields, differences
from siltstone.operators.incremental import CommitLog, unread_objects
from siltstone.operators.quality import check_packs, compare_profiles
from siltstone.shared import scratch

PAIR = "list_id bigint, obj_id bigint, key string, value string"
META = "list_id bigint, obj_id bigint, timestamp double"
LIST = "list_id bigint, done boolean, received_at timestamp_ntz"
RUN = "from_obj_id bigint, upto_obj_id bigint, from_at timestamp_ntz, cut_at timestamp_ntz, done boolean"


def at(n):
    from datetime import datetime

    return None if n is None else datetime(2025, 3, 1 + n // 24, n % 24)


def tables(spark, pairs, meta, lists, runs):
    return (
        spark.createDataFrame([(a, b, "k", None) for a, b in pairs], PAIR),
        spark.createDataFrame(meta, META),
        spark.createDataFrame([(a, d, at(n)) for a, d, n in lists], LIST),
        spark.createDataFrame([(a, b, at(x), at(y), d) for a, b, x, y, d in runs], RUN),
    )


def brute_unread(pairs, meta, lists, runs):
    best = {}
    for lid, obj in pairs:
        if lid is None or obj is None:
            continue
        for l2, done, n in lists:
            if l2 == lid and done:
                stamps = [s for a, b, s in meta if (a, b) == (lid, obj) and s is not None]
                version = max(stamps) if stamps else float("-inf")
                seen = any(d and None not in (a, b, x, y, n) and a <= obj <= b and x < n <= y for a, b, x, y, d in runs)
                best.setdefault(obj, []).append((version, seen))
    return {o for o, v in best.items() if not any(s for w, s in v if w == max(v)[0])}


def test_unread_against_brute_force(spark):
    rnd = random.Random(3)
    some = lambda *x: rnd.choice(x)
    for _ in range(4):
        pairs = [(some(1, 2, 3, 4, 5, 6, None), some(*range(8), None)) for _ in range(40)]
        meta = [(some(1, 2, 3, 4, 5, 6), rnd.randrange(8), some(1.0, 2.0, 3.0, None, float("inf"))) for _ in range(30)]
        lists = [(i, some(True, True, False, None), some(*range(0, 60, 5), None)) for i in range(1, 7)]
        lists += lists[:2]
        runs = [(some(0, 2, None), some(3, 5, 7), some(0, 10, 20), some(25, 40, 59, None), some(True, True, False, None)) for _ in range(4)]
        got = {r[0] for r in unread_objects(*tables(spark, pairs, meta, lists, runs)).collect()}
        assert got == brute_unread(pairs, meta, lists, runs)


def test_unread_of_empty_tables(spark):
    empty = tables(spark, [], [], [], [])
    assert unread_objects(*empty).count() == 0
    no_runs = tables(spark, [(1, 5), (1, 5)], [], [(1, True, 3)], [])
    assert [r[0] for r in unread_objects(*no_runs).collect()] == [5]


def test_log_takes_each_object_once(spark):
    log = CommitLog(spark, scratch(spark, "log"))
    lists = [(1, True, 3), (2, True, 5)]
    first = tables(spark, [(1, 5), (2, 6)], [(1, 5, 1.0)], lists, [(6, 6, 0, 9, True)])
    log.take_unread(*first)
    assert [r[0] for r in log.output().collect()] == [5]
    log.take_unread(*first)
    assert log.output().count() == 1
    # a newer state of 6, an older one of 5, and a list that broke off
    later = tables(spark, [(1, 5), (2, 6), (3, 6), (3, 5), (4, 7)], [(1, 5, 1.0), (3, 6, 9.0), (3, 5, 0.5)], [*lists, (3, True, 7), (4, False, 8)], [(6, 6, 0, 6, True)])
    entry = log.take_unread(*later)
    assert sorted(r[0] for r in log.output().collect()) == [5, 6] and entry["after"] < entry["watermark"]


def test_lists_that_come_late_are_taken_once(spark):
    """After a first run: lists received at the time of its last one, before it, at no time, and one completed later; a failed run between."""
    log = CommitLog(spark, scratch(spark, "log"))
    lists = [(1, True, 10), (5, False, 4)]
    log.take_unread(*tables(spark, [(1, 100), (5, 500)], [(1, 100, 1.0), (5, 500, 1.0)], lists, []))
    lists = [(1, True, 10), (2, True, 10), (3, True, 5), (4, True, None), (5, True, 4), (6, True, 10)]
    pairs, meta = [(1, 100), (2, 200), (3, 300), (4, 400), (5, 500), (6, 100)], [(i, 100 * i, 1.0) for i in range(1, 6)] + [(6, 100, 1.0)]
    later = tables(spark, pairs, meta, lists, [])

    def lost():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        log.take_unread(*later, before_commit=lost)
    assert [r[0] for r in log.output().collect()] == [100] and len(log.commits()) == 1
    log.take_unread(*later)
    assert sorted(r[0] for r in log.output().collect()) == [100, 200, 300, 400, 500]
    assert sorted(r[0] for r in log.output(1).collect()) == [200, 300, 400, 500]
    log.take_unread(*later)
    assert log.output(2).count() == 0


def test_log_in_steps_against_brute_force(spark, monkeypatch):
    from siltstone.operators import incremental

    monkeypatch.setattr(incremental, "MERGE_AT", 2)
    rnd = random.Random(8)
    pairs = [(rnd.randrange(12), rnd.randrange(9)) for _ in range(60)]
    meta = [(a, b, rnd.choice([None, 1.0, 2.0, 3.0, float("nan")])) for a, b in pairs]
    lists = [(i, True, rnd.choice([None, 1, 5, 9])) for i in range(12)]
    rnd.shuffle(lists)
    log, known = CommitLog(spark, scratch(spark, "log")), {}
    for step in range(1, 5):
        log.take_unread(*tables(spark, pairs, meta, lists[: 3 * step], []))
        now = {}
        for lid, obj in pairs:
            if lid in {x[0] for x in lists[: 3 * step]}:
                stamps = [s for a, b, s in meta if (a, b) == (lid, obj) and s is not None and s == s]
                now[obj] = max(now.get(obj, -1.0), max(stamps, default=0.0))
        assert {r[0] for r in log.output(step - 1).collect()} == {o for o, v in now.items() if v > known.get(o, -1.0)}
        known = now


def test_rows_at_the_watermark(spark):
    source = lambda *r: spark.createDataFrame(r, "seq bigint, k string")
    log = CommitLog(spark, scratch(spark, "log"))
    log.run(source((1, "a"), (2, "b"), (None, "z")), "seq", key=["k"])
    log.run(source((1, "a"), (2, "b"), (2, "c"), (2, None)), "seq", key=["k"])
    assert log.run(source((1, "a"), (2, "b"), (2, "c"), (2, None)), "seq", key=["k"]) is None
    log.run(source((1, "a"), (2, "b"), (2, "c"), (2, None), (2, "d"), (3, "b")), "seq", key=["k"])
    assert sorted((r["seq"], r["k"] or "") for r in log.output().collect()) == [(1, "a"), (2, ""), (2, "b"), (2, "c"), (2, "d"), (3, "b")]


def test_tiles_cover_every_id_once(spark):
    from siltstone.operators.incremental import LEAST, MOST, complete_lists, read_tiles

    _, _, lists, runs = tables(spark, [], [], [(1, True, 5), (2, True, 50), (3, True, None)], [(3, 9, 0, 9, True), (5, 6, 0, 9, True), (7, 12, 0, 9, True), (13, 13, 0, 9, True), (20, MOST, 0, 9, True), (LEAST, LEAST, 0, 9, True)])
    got = {}
    for r in read_tiles(complete_lists(lists), runs).collect():
        got.setdefault(r["list_id"], []).append((r["lo"], r["hi"], r["read"]))
    assert set(got) == {1, 2, 3} and got[2] == got[3] == [(LEAST, MOST, False)]
    own = sorted(got[1])
    assert own[0][0] == LEAST and own[-1][1] == MOST and all(a[1] + 1 == b[0] for a, b in zip(own, own[1:]))
    assert {x for lo, hi, read in own if read and hi - lo < 99 for x in range(lo, hi + 1)} == {LEAST, *range(3, 14)} and (20, MOST, True) in own


def test_failed_run_is_repeated_and_races_lose(spark):
    source = spark.range(10).withColumnRenamed("id", "seq")
    log = CommitLog(spark, scratch(spark, "log"))

    def broken(df):
        return df.select(F.raise_error(F.lit("lost")).alias("x"))

    with pytest.raises(PySparkException):
        log.run(source, "seq", broken)
    assert log.commits() == [] and log.output() is None
    log.run(source.where("seq < 4"), "seq")
    assert log.run(source.where("seq < 4"), "seq") is None
    log.run(source, "seq")
    assert sorted(r[0] for r in log.output().collect()) == list(range(10))
    with pytest.raises(Exception):  # noqa: B017
        log._manifest.add(1, {"watermark": 0})
    assert [c["watermark"] for c in log.commits()] == [3, 9]


PACK = "attr_id bigint, load_no int, pack_no int, pack_type int, no_obj bigint, no_nulls bigint, min_n bigint, max_n bigint, ver bigint"


def test_packs(spark):
    rows = [
        (1, 1, 0, 10, 100, 0, 0, 99, 1), (1, 1, 0, 10, 100, 0, 0, 99, 1),  # alike
        (1, 2, 0, 10, 100, 10, 0, 99, 1),  # share moved by exactly 0.10
        (1, 3, 0, 10, 100, 21, 0, 99, 1),  # more than 0.10
        (1, 4, 0, 10, 0, 0, None, None, 1),  # no rows: impossible, the load has no packs
        (1, 5, 0, 10, 100, 21, 50, 149, 1),  # exactly half of the range in both
        (1, 6, 0, 10, 100, 21, 101, 200, 1),  # 49 of 100
        (2, 1, 0, 30, 5, 0, 1, None, 1), (2, 1, 1, 30, 5, 6, None, None, 1), (2, 1, 2, 30, 5, None, None, None, 1),
        (2, 1, 3, 10, 5, 5, None, None, 1), (2, 1, 4, 10, 5, 4, 7, 6, 1), (2, 1, 5, None, 65536, 0, None, None, None), (2, 1, 6, 20, 65537, 0, None, None, 1),
        (3, 1, 0, 10, 10, 0, 5, 5, 1), (3, 1, 0, 10, 10, 20, 5, 5, 2),  # the higher ver counts
        (4, 1, 0, 10, 10, 0, -(2**63), 2**63 - 1, 1), (4, 2, 0, 10, 10, 0, 0, 2**63 - 1, 1),
    ]
    got = {tuple(r) for r in check_packs(spark.createDataFrame(rows, PACK).withColumn("kind", F.lit("x"))).collect()}
    assert got == {
        ("load", 1, 3, -1), ("pack", 1, 4, 0), ("load", 1, 6, -1), ("pack", 2, 1, 0), ("pack", 2, 1, 1), ("pack", 2, 1, 2), ("pack", 2, 1, 4), ("pack", 2, 1, 6), ("pack", 3, 1, 0), ("load", 4, 2, -1),
    } - {("load", 4, 2, -1)}
    assert check_packs(spark.createDataFrame([], PACK)).count() == 0


def test_loads_over_blocks(spark):
    rows = [(1, n, 0, 30, 100, 0 if n < 5000 else 50, None, None, 1) for n in (1, 4095, 4096, 5000, 9000)]
    assert [tuple(r) for r in check_packs(spark.createDataFrame(rows, PACK)).collect()] == [("load", 1, 5000, -1)]


def test_profiles_of_files(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from siltstone.sources.footers import profile_columns

    t = pa.table({"a": [1, 2, None, 2], "s": ["x1", "", None, "x2"], "f": [1.5, float("nan"), None, 2.0], "e": pa.array([None] * 4, pa.int64())})
    (tmp_path / "t").mkdir()
    pq.write_table(t, tmp_path / "t" / "a.parquet", row_group_size=2)
    pq.write_table(t, tmp_path / "t" / "b.parquet", write_statistics=False)
    got = {r["column_name"]: r for r in profile_columns(spark, str(tmp_path / "t"), {"s": "^x"}).collect()}
    assert {k: (r["rows"], r["nulls"], r["n_distinct"]) for k, r in got.items()} == {"a": (8, 2, 2), "s": (8, 2, 3), "f": (8, 2, 3), "e": (8, 8, 0)}
    assert (got["a"]["low"], got["a"]["high"], got["a"]["chunks"], got["a"]["from_footer"]) == ("1", "2", 3, 2)
    assert (got["a"]["scanned"], got["f"]["scanned"], got["s"]["scanned"]) == (1, 3, 2)
    assert got["s"]["violations"] == 2 and got["a"]["violations"] is None and got["e"]["low"] is None
    p = spark.createDataFrame([tuple(r) for r in got.values()], "column_name string, kind string, rows bigint, nulls bigint, n_distinct bigint, low string, high string, violations bigint, chunks bigint, from_footer bigint, scanned bigint")
    assert not any(r["changed"] for r in compare_profiles(p, p).collect())
    moved = p.withColumn("nulls", F.when(F.col("column_name") == "a", 6).otherwise(F.col("nulls")))
    assert [r["column_name"] for r in compare_profiles(p, moved).where("changed").collect()] == ["a"]


def test_extrema_are_compared_as_what_they_are(spark, tmp_path):
    import datetime
    from decimal import Decimal

    import pyarrow as pa
    import pyarrow.parquet as pq

    from siltstone.sources.footers import chunk_statistics, profile_columns

    t = pa.table(
        {
            "d": pa.array([Decimal("9.5"), Decimal("10.0"), Decimal("-100.5"), None], pa.decimal128(5, 1)),
            "wide": pa.array([Decimal(-(10**30)), Decimal(9), Decimal(10**30), Decimal(0)], pa.decimal128(38, 0)),
            "n": [-9007199254740993, -9007199254740992, 10, 9],
            "u": pa.array([2**64 - 1, 2**64 - 2, 5, 10], pa.uint64()),
            "s": ["b", "a", "é", "Z"],
            "f": [9.5, 10.0, float("nan"), -1.0],
            "t": pa.array([-1, 5, 10**15, 9], pa.timestamp("us")),
            "day": pa.array([-1, 5, 9, 10], pa.date32()),
            "raw": pa.array([b"\xff", b"\x00", b"\x10", None], pa.binary()),
            "yes": [True, False, None, True],
        }
    )
    (tmp_path / "t").mkdir()
    pq.write_table(t, tmp_path / "t" / "a.parquet", row_group_size=1)
    pq.write_table(t.slice(0, 2), tmp_path / "t" / "b.parquet", write_statistics=False)
    chunks = chunk_statistics(spark, str(tmp_path / "t"))
    assert chunks.rdd.getNumPartitions() == 5 and chunks.count() == 50
    got = {r["column_name"]: (r["low"], r["high"]) for r in profile_columns(spark, str(tmp_path / "t")).collect()}
    moment = lambda us: (datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=us)).isoformat(" ", "microseconds")
    assert got == {
        "d": ("-100.5", "10.0"), "wide": (str(-(10**30)), str(10**30)), "n": ("-9007199254740993", "10"), "u": ("5", str(2**64 - 1)), "s": ("Z", "é"),
        "f": ("-1.0", "10.0"), "t": (moment(-1), moment(10**15)), "day": ("1969-12-31", "1970-01-11"), "raw": ("00", "ff"), "yes": ("False", "True"),
    }
    assert {r["column_name"]: r["n_distinct"] for r in profile_columns(spark, str(tmp_path / "t"), approximate=True).collect()}["n"] == 4
    pq.write_table(pa.table({"n": pa.array([3], pa.int32()), "s": pa.array([1], pa.int64())}), tmp_path / "c.parquet")
    from siltstone.sources.footers import column_profiles

    mixed = chunks.unionByName(chunk_statistics(spark, str(tmp_path / "c.parquet")))
    got = {r["column_name"]: (r["low"], r["high"]) for r in column_profiles(mixed).collect()}
    assert got["n"] == ("-9007199254740993", "10") and got["s"] == (None, None)


def test_dictionaries_against_the_data(tmp_path):
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    from siltstone.sources import pages

    rnd = random.Random(4)
    n = 3000
    t = pa.table(
        {
            "i": pa.array([rnd.choice([None, 1, -5, 2**31 - 1]) for _ in range(n)], pa.int32()),
            "l": pa.array([rnd.choice([None, 2**62, -1]) for _ in range(n)]),
            "d": [rnd.choice([None, 0.5, -0.0, 0.0, float("nan")]) for _ in range(n)],
            "s": [rnd.choice([None, "", "é", "long" * 50]) for _ in range(n)],
            "t": pa.array([rnd.choice([None, 1, 10**15]) for _ in range(n)], pa.timestamp("us")),
            "many": [str(rnd.random()) * 20 for _ in range(n)],
            "none": pa.array([None] * n, pa.int64()),
        }
    )
    for codec in ("none", "snappy", "gzip", "zstd", "lz4", "brotli"):
        for version in ("1.0", "2.0"):
            path = tmp_path / f"{codec}{version}.parquet"
            pq.write_table(t, path, compression=codec, row_group_size=1000, data_page_version=version, dictionary_pagesize_limit=20_000, write_batch_size=100)
            with pa.OSFile(str(path)) as f:
                groups = pages.chunks(f)
                assert len(groups) == 3
                for g, own in enumerate(groups):
                    part = t.slice(g * 1000, 1000)
                    assert not own["many"].complete and pages.dictionary(f, own["many"]) is None
                    for name in ("i", "l", "d", "s", "t"):
                        words = pages.dictionary(f, own[name])
                        want = pages.hashes(pages.physical(part[name].combine_chunks().drop_null()))
                        assert words is not None and set(pages.hashes(words)) == set(want), (codec, name)
            assert np.isclose(pq.read_metadata(path).num_rows, n)


MESSAGE = "queryid bigint, delivery_id bigint, timestamp double, batch_id bigint, held_row string, prefix int"


def brute_dropped(rows):
    best, inf = {}, float("inf")
    key = lambda r: (inf if r[2] is None or r[2] != r[2] else r[2], r[1])
    for r in rows:
        if r[0] is not None and (r[0] not in best or key(r) < key(best[r[0]])):
            best[r[0]] = r
    return {r[1] for r in rows if r[0] is not None and best[r[0]] is not r}


@pytest.mark.parametrize("rounds", [1, 3])
def test_copies_against_brute_force(spark, rounds):
    rnd = random.Random(rounds)
    rows = [(rnd.choice([7] * 60 + [None] + list(range(-20, 100))), i, rnd.choice([None, 1.0, 2.0, 3.0, float("nan")]), rnd.choice([None, 1, 2, 3, 4]), "x", 0) for i in range(500)]
    index = IdentifierIndex(spark, scratch(spark, "index"), merge_at=2, per_prefix=50)
    kept, dropped = split_copies(spark.createDataFrame(rows, MESSAGE), index, "queryid", "delivery_id", "timestamp", "batch_id", rounds)
    gone = brute_dropped(rows)
    assert {r["delivery_id"] for r in dropped.collect()} == gone
    assert sorted(r["delivery_id"] for r in kept.collect()) == sorted({r[1] for r in rows} - gone)
    assert kept.columns == dropped.columns == [c.split()[0] for c in MESSAGE.split(", ")]


def test_index_keeps_the_best_over_batches(spark):
    index = IdentifierIndex(spark, scratch(spark, "index"))
    batch = lambda *r: spark.createDataFrame(r, "id string, stamp double, row bigint")
    index.ingest(batch(("a", 5.0, 1), ("b", None, 2)), "1")
    index.ingest(batch(("a", 4.0, 9), ("b", None, 3), ("c", 1.0, 4)), "2")
    index.ingest(batch(("zz", 0.0, 99)), "2")  # taken in before
    index.ingest(batch(), "3")
    want = {("a", 9), ("b", 2), ("c", 4)}
    assert {(r["id"], r["row"]) for r in index.kept().collect()} == want
    index.merge()
    index.vacuum()
    assert {(r["id"], r["row"]) for r in index.kept().collect()} == want


def test_prefixes_grow_with_the_index(spark):
    import glob

    import pyarrow.parquet as pq

    index = IdentifierIndex(spark, scratch(spark, "index"), per_prefix=1000)
    rows = lambda n, shift: spark.range(n).selectExpr("id * 7 as id", "cast(1 as double) as stamp", f"id + {shift} as row")
    index.ingest(rows(10, 0), "1")
    index.ingest(rows(40_000, 100), "2")
    index.ingest(rows(50_000, 1_000_000), "3")
    index.merge()
    run = index._state()["runs"][0]
    sizes = [sum(pq.read_metadata(f).num_rows for f in glob.glob(f"{p}/*.parquet")) for p in glob.glob(run["path"].removeprefix("file:") + "/prefix=*")]
    assert run["bits"] == 6 and len(sizes) == 64 and sum(sizes) == 50_000 and max(sizes) < 1000
    kept = {r["id"]: r["row"] for r in index.kept().collect()}
    assert kept == {7 * i: i if i < 10 else i + 100 if i < 40_000 else i + 1_000_000 for i in range(50_000)}
    seen = index._arranged(rows(100, 0), 7)
    assert seen.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_copies_of_an_empty_table(spark):
    kept, dropped = split_copies(spark.createDataFrame([], MESSAGE), IdentifierIndex(spark, scratch(spark, "index")), "queryid", "delivery_id", "timestamp", "batch_id")
    assert kept.count() == dropped.count() == 0


def test_changes_against_replay(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("ab") if rnd.random() < 0.9 else None, rnd.choice(["x", "X", "", None]), rnd.choice([None, 1.0, 2.0, 3.0, 4.0]), i, rnd.choice([0, 1, 1, 2, 9, None])) for i in range(300)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "bucket string, key string, t double, n bigint, cmd int").withColumn("__last", F.lit(1))
    base = spark.createDataFrame([("c", "x", -1), ("a", "x", -2)], "bucket string, key string, n bigint")
    state = {("c", "x"): -1, ("a", "x"): -2}
    for b, k, t, n, cmd in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[3])):
        if cmd == 1:
            state[b, k] = n
        elif cmd == 2:
            state.pop((b, k), None)
    for slices in (1, 4):
        got = apply_changes(df, ["bucket", "key"], F.col("t"), [F.col("n")], F.col("cmd") == 1, F.col("cmd") == 2, ["n"], base, slices)
        assert {(r["bucket"], r["key"]): r["n"] for r in got.collect()} == state
    assert apply_changes(df.limit(0), ["bucket", "key"], F.col("t"), [F.col("n")], F.col("cmd") == 1, F.col("cmd") == 2, ["n"], base).count() == 2


def test_differences(spark):
    shape = "key string, v string, n bigint, a string"
    a = spark.createDataFrame([("1", "x", 1, ""), ("1", "x", 1, ""), ("2", None, 1, ""), ("3", "", 1, ""), (None, "x", 1, ""), ("5", "x", 1, ""), ("6", "a", 1, ""), ("6", "c", 1, ""), ("6", "b", 1, ""), ("7", "s ", 1, "")], shape)
    b = spark.createDataFrame([("1", "x", 1, "z"), ("2", "", 1, ""), ("3", "", 2, ""), (None, "x", None, ""), ("4", "x", 1, ""), ("6", "a", 1, ""), ("6", "c", 1, ""), ("7", "s", 1, "")], shape)
    got = {tuple(r) for r in difference_fields(differences(a, b, "key", ["v", "n"]), "key").collect()}
    assert got == {("2", "v"), ("3", "n"), (None, "n"), ("4", "only_b"), ("5", "only_a"), ("6", "*"), ("7", "v")}
    trimmed = differences(a, b, "key", ["v"], lambda _, c: F.rtrim(c))
    assert "7" not in {r["key"] for r in trimmed.collect()}
    both = spark.createDataFrame([("k", str(i), 1, "") for i in range(50) for _ in range(2)], shape)
    for gone in range(0, 50, 7):  # of many rows of one key any may be missing
        assert [tuple(r) for r in difference_fields(differences(both, both.where(f"v <> '{gone}'"), "key", ["v", "n"]), "key").collect()] in ([("k", "*")], [("k", "v")])
    assert differences(both, both.distinct(), "key", ["v", "n"]).count() == 0
    for kind, x, y in (("bigint", 0, 7), ("date", "1970-01-01", "1971-01-01"), ("boolean", "true", "false"), ("array<int>", None, None), ("double", 0, 1)):
        one, other = (spark.createDataFrame([(v, 1), (None, i)], "key string, n int").selectExpr(f"cast(key as {kind}) as key" if kind != "array<int>" else "array(n) as key", "n") for i, v in ((1, str(x)), (2, str(y))))
        assert len(difference_fields(differences(one, other, "key", ["n"]), "key").collect()) == (3 if kind != "array<int>" else 1), kind
    values = {r["key"]: r["differences"] for r in differences(a, b, "key", ["v"]).where("side is null").collect()}
    assert tuple(values["2"][0]) == ("v", None, "")
    assert differences(a.limit(0), b.limit(0), "key", ["v"]).count() == 0


def test_hot_keys_stay_spread(spark):
    """No task of the plans has to hold the rows of one key: they are reduced before they are moved."""
    df = spark.range(1000).selectExpr("'b' as bucket", "'k' as key", "cast(id as double) as t", "id as n", "1 as cmd")
    state = apply_changes(df, ["bucket", "key"], F.col("t"), [F.col("n")], F.col("cmd") == 1, F.col("cmd") == 2, ["n"])
    assert [tuple(r) for r in state.collect()] == [("b", "k", 999)]
    pairs = df.selectExpr("1 as list_id", "7 as obj_id", "key", "key as value")
    parts = tables(spark, [], [(1, 7, 2.0)], [(1, True, 3)], [])
    assert [tuple(r) for r in unread_objects(pairs, *parts[1:]).collect()] == [(7, 2.0)]
