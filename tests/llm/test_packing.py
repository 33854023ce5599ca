"""Packing: nothing lost, nothing split without need, few containers."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm.packing import combinations, nonnegative_least_squares, pack, plan


def check_plan(histogram, capacity):
    kinds = plan(histogram, capacity)
    used = Counter()
    for times, lengths in kinds:
        assert times > 0 and 0 < sum(lengths) <= capacity
        for n in lengths:
            used[n] += times
    assert used == Counter({n: c for n, c in histogram.items() if c})
    return sum(t for t, _ in kinds)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.data())
def test_plan_holds_everything(capacity, data):
    histogram = data.draw(st.dictionaries(st.integers(1, capacity), st.integers(0, 10**9), max_size=30))
    n = check_plan(histogram, capacity)
    total = sum(k * v for k, v in histogram.items())
    assert n >= -(-total // capacity)
    assert n <= 2 * total / capacity + 1


def test_plan_is_near_the_bound():
    rnd = random.Random(1)
    for capacity, top in ((512, 512), (2048, 900), (8192, 3000)):
        histogram = Counter(min(capacity, max(1, int(rnd.lognormvariate(5.2, 0.9))) % top + 1) for _ in range(20000))
        total = sum(k * v for k, v in histogram.items())
        assert check_plan(histogram, capacity) <= 1.01 * -(-total // capacity) + 1
    assert check_plan({300: 1000, 200: 1000, 12: 1000}, 512) == 1000
    assert check_plan({300: 10**9}, 512) == 10**9


def test_least_squares_against_brute_force():
    rnd = np.random.default_rng(0)
    for _ in range(20):
        a, b = rnd.integers(0, 3, (4, 6)).astype(float), rnd.integers(0, 9, 4).astype(float)
        best = min(np.linalg.norm(a[:, s] @ x - b) for m in range(1, 64) if (s := [i for i in range(6) if m >> i & 1]) and (x := np.linalg.lstsq(a[:, s], b, rcond=None)[0]).min() >= -1e-9)
        best = min(best, np.linalg.norm(b))
        x = nonnegative_least_squares(a, b)
        assert x.min() >= 0 and np.linalg.norm(a @ x - b) <= best + 1e-6


def test_combinations():
    found = combinations(np.array([6, 4, 3]), 10, 0.9, 3)
    assert set(found) == {(6, 4), (6, 3), (3, 3, 3), (4, 3, 3)} and len(found) == len(set(found))


def test_pack(spark):
    sizes = [(i, n) for i, n in enumerate([5, 5, 10, 3, 7, 25, 1, 1, 100, 0, None] + [5] * 400)]
    sized = spark.createDataFrame(sizes + [(3, 3)], "doc_id bigint, n_tokens bigint").withColumn("bin", sized_column())
    containers = spark.createDataFrame([("small", 10), ("small", 10), ("large", 64), ("none", 0), ("null", None)], "container string, capacity int")
    bins = pack(sized, containers).collect()
    for name, capacity in (("small", 10), ("large", 64)):
        own = [b for b in bins if b["container"] == name]
        assert sorted(b["bin"] for b in own) == list(range(len(own)))
        got = Counter()
        for b in own:
            assert b["fill"] == sum(b["lens"]) <= capacity
            for i, s, n in zip(b["doc_ids"], b["starts"], b["lens"]):
                got[i, s, n] += 1
                whole = dict(sizes)[i]
                assert n == whole or (whole > capacity and s % capacity == 0 and n == min(capacity, whole - s))
        whole = Counter()
        for (i, _, n), k in got.items():
            whole[i] += n * k
        assert whole == Counter({i: n for i, n in sizes if n}) + Counter({3: 3})
    assert {b["container"] for b in bins} == {"small", "large"}
    assert pack(sized.limit(0), containers).count() == 0
    assert pack(sized, containers.limit(0)).count() == 0


def sized_column():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_refused_containers(spark):
    sized = spark.createDataFrame([(1, 1)], "doc_id bigint, n_tokens bigint")
    with pytest.raises(ValueError):
        pack(sized, spark.createDataFrame([("a", 1), ("a", 2)], "container string, capacity int"))


def test_any_number_and_size_of_containers(spark):
    sized = spark.createDataFrame([(i, 1 + i % 7) for i in range(50)] + [(99, 6_000_000)], "doc_id bigint, n_tokens bigint")
    limits = [(f"c{i:02d}", 7 + i) for i in range(12)] + [("large", 5_000_000)]
    found = pack(sized.where("doc_id < 99"), spark.createDataFrame(limits[:12], "container string, capacity int")).groupBy("container").sum("fill").collect()
    total = sum(1 + i % 7 for i in range(50))
    assert sorted((r[0], r[1]) for r in found) == [(n, total) for n, _ in limits[:12]]
    large = pack(sized, spark.createDataFrame(limits[12:], "container string, capacity int")).collect()
    assert sorted(b["fill"] for b in large) == [1_000_000 + total, 5_000_000]


def test_plan_of_many_lengths():
    """The work grows about with the number of lengths: a hundred thousand of them take no minute, and fill about as well as best fit alone."""
    import time

    from siltstone.llm.packing import Stock, _best_fit, plan_kinds, runs

    rnd = np.random.default_rng(0)
    histogram = {int(n): int(rnd.integers(1, 50)) for n in rnd.choice(np.arange(1, 131073), 100_000, replace=False)}
    began = time.process_time()
    kinds = plan_kinds(histogram, 131072)
    assert time.process_time() - began < 60
    used = Counter()
    for times, items in kinds:
        assert times > 0
        for n, k in runs(items):
            used[n] += times * k
    assert used == Counter(histogram)
    assert sum(t for t, _ in kinds) <= 1.0001 * sum(t for t, _ in _best_fit([], Stock(histogram, 1), 131072))


def test_ordered_set():
    from siltstone.llm.packing import Ordered

    rnd = random.Random(3)
    held, own = set(), Ordered()
    for _ in range(3000):
        x = rnd.choice([rnd.randrange(20), rnd.randrange(20000), 4095, 4096])
        held.add(x) if rnd.random() < 0.6 else held.discard(x)
        own.add(x) if x in held else own.discard(x)
        y = rnd.randrange(20000)
        assert own.up(y) == min((h for h in held if h >= y), default=None) and own.down(y) == max((h for h in held if h <= y), default=None)
    assert own.down(-1) is None
