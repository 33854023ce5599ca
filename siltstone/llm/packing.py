"""Filling containers of fixed capacity with items of varying length.

The plan is made from the histogram of lengths, which is no larger than the capacity however many
items there are: shallow combinations of length classes that fill a window below the capacity,
repeat counts by non-negative least squares against the histogram, rounded, and a best-fit
pass that packs what is left into the gaps and into new containers. Items are then ranked within
their length and look their container up in the plan.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.shared import materialize

#: Length classes per capacity; the least fill of a combination, as a share of the capacity; items per combination.
CLASSES, WINDOW, DEPTH = 128, 0.99, 3
#: Shares of the solved repeat counts that are tried; what isn't used stays with the best-fit pass, which needs items to choose from.
SHARES = (1.0, 0.75, 0.5, 0.25, 0.1)
#: Least number of parts in which the items of one length are ranked, and the items that a part is meant for.
PARTS, PER_PART = 64, 500_000
#: Kinds of containers that are planned and looked up together.
GROUP = 8


def combinations(present: np.ndarray, classes: int, window: float, depth: int) -> list[tuple[int, ...]]:
    """Descending tuples of up to ``depth`` of the classes present whose sum lies in [window * classes, classes]."""
    least, found = int(np.ceil(window * classes)), []
    levels = [((int(c),), int(c)) for c in present]
    for level in range(depth):
        found += [c for c, total in levels if least <= total <= classes]
        if level + 1 < depth:
            levels = [((*c, int(d)), total + int(d)) for c, total in levels for d in present if d <= c[-1] and total + d <= classes]
    return found


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that about minimises |a x - b|: the active-set method, with at most ``rounds`` columns entering."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    gram_b = a.T @ b
    for _ in range(rounds):
        slope = gram_b - a.T @ (a[:, active] @ x[active])
        slope[active] = -np.inf
        enter = int(np.argmax(slope))
        if slope[enter] <= 1e-6 * max(1.0, np.abs(gram_b).max()):
            break
        active[enter] = True
        while True:
            columns = np.flatnonzero(active)
            wanted = np.linalg.lstsq(a[:, columns], b, rcond=None)[0]
            low = wanted <= 0
            if not low.any():
                x[:] = 0
                x[columns] = wanted
                break
            now = x[columns]
            step = np.min(now[low] / np.maximum(now[low] - wanted[low], 1e-300))
            x[columns] = np.maximum(now + step * (wanted - now), 0)
            drop = columns[low & (x[columns] <= 1e-12)]
            if not len(drop):
                drop = columns[low][:1]
            x[drop], active[drop] = 0, False
    return x


class Ordered:
    """A set of whole numbers from 0 with their order: bits in blocks, and a bit for each block that isn't empty."""

    def __init__(self, members: Iterable[int] = ()):
        self._blocks: dict[int, int] = {}
        self._top = 0
        for x in members:
            self.add(x)

    def add(self, x: int) -> None:
        self._blocks[x >> 12] = self._blocks.get(x >> 12, 0) | 1 << (x & 4095)
        self._top |= 1 << (x >> 12)

    def discard(self, x: int) -> None:
        left = self._blocks.get(x >> 12, 0) & ~(1 << (x & 4095))
        self._blocks[x >> 12] = left
        if not left:
            self._top &= ~(1 << (x >> 12))

    def up(self, x: int) -> int | None:
        """The least member that isn't below x."""
        block = x >> 12
        word = self._blocks.get(block, 0) >> (x & 4095)
        if word:
            return x + (word & -word).bit_length() - 1
        top = self._top >> (block + 1)
        if not top:
            return None
        block += (top & -top).bit_length()
        word = self._blocks[block]
        return (block << 12) + (word & -word).bit_length() - 1

    def down(self, x: int) -> int | None:
        """The greatest member that isn't above x."""
        if x < 0:
            return None
        block = x >> 12
        word = self._blocks.get(block, 0) & ((2 << (x & 4095)) - 1)
        if not word:
            block = (self._top & ((1 << block) - 1)).bit_length() - 1
            if block < 0:
                return None
            word = self._blocks[block]
        return (block << 12) + word.bit_length() - 1


#: (repeats, items) of a kind of container; items is (items before, length, number) or None.
Kind = tuple[int, tuple | None]


class Stock:
    """The items not placed yet, by length, and how many there are of each class of lengths."""

    def __init__(self, histogram: dict[int, int], width: int):
        self.left = {n: c for n, c in histogram.items() if c > 0}
        self.width, self.there = width, Ordered(self.left)
        self.classes: dict[int, int] = defaultdict(int)
        for n, c in self.left.items():
            self.classes[-(-n // width)] += c

    def take(self, n: int, count: int) -> None:
        self.left[n] -= count
        self.classes[-(-n // self.width)] -= count
        if not self.left[n]:
            del self.left[n]
            self.there.discard(n)

    def longest(self, upto: int, above: int, taken: list[int]) -> int | None:
        """The longest length in (above, upto] of which more items are left than ``taken`` has."""
        n = self.there.down(upto)
        while n is not None and n > above and self.left[n] <= taken.count(n):
            n = self.there.down(n - 1)
        return n if n is not None and n > above else None

    def shortest(self, above: int, upto: int, taken: list[int]) -> int | None:
        n = self.there.up(above + 1)
        while n is not None and n <= upto and self.left[n] <= taken.count(n):
            n = self.there.up(n + 1)
        return n if n is not None and n <= upto else None


def plan(histogram: dict[int, int], capacity: int, classes: int = CLASSES, window: float = WINDOW, depth: int = DEPTH) -> list[tuple[int, tuple[int, ...]]]:
    """(repeats, lengths) of each kind of container; all items of the histogram, lengths 1 to capacity, are in one."""
    return [(times, tuple(n for n, k in runs(items) for _ in range(k))) for times, items in plan_kinds(histogram, capacity, classes, window, depth)]


def runs(items: tuple | None) -> list[tuple[int, int]]:
    """(length, number) of the items of a kind, each length once."""
    total: dict[int, int] = defaultdict(int)
    while items is not None:
        items, n, k = items
        total[n] += k
    return list(total.items())


def plan_kinds(histogram: dict[int, int], capacity: int, classes: int = CLASSES, window: float = WINDOW, depth: int = DEPTH) -> list[Kind]:
    """The plan with the fewest containers among those that use different SHARES of the solved repeat counts; of equal ones the one that uses most of them.

    Depends on the histogram alone. Lengths are looked up in order, so the work grows with the number
    of different lengths and kinds, not with their square.
    """
    held = {n: c for n, c in histogram.items() if c > 0}
    if not held:
        return []
    width = max(1, capacity // classes)
    top = capacity // width  # classes that fit
    count = Stock(held, width).classes
    present = np.array(sorted((c for c in count if c <= top), reverse=True))
    useful = combinations(present, top, window, depth) if len(present) else []
    solved: list[tuple[tuple[int, ...], float]] = []
    if useful:
        place = {int(c): i for i, c in enumerate(present)}
        a = np.zeros((len(present), len(useful)))
        for j, combo in enumerate(useful):
            for c in combo:
                a[place[c], j] += 1
        weight = np.sqrt(present / top)  # what stays over of long items costs more
        x = nonnegative_least_squares(a * weight[:, None], np.array([count[int(c)] for c in present], float) * weight)
        solved = [(useful[j], x[j]) for j in sorted(np.flatnonzero(x >= 0.5), key=lambda j: (-sum(useful[j]), len(useful[j]), useful[j]))]
    least = -(-sum(n * c for n, c in held.items()) // capacity)
    best: list[Kind] = []
    fewest = None
    for share in SHARES if solved else (0.0,):
        stock = Stock(held, width)
        kinds = [k for combo, x in solved for k in _repeat(combo, int(round(x * share)), stock, capacity)]
        kinds = _best_fit(kinds, stock, capacity)
        used = sum(times for times, _ in kinds)
        if fewest is None or used < fewest:
            best, fewest = kinds, used
        if fewest == least:
            break
    return best


def _repeat(combo: tuple[int, ...], times: int, stock: Stock, capacity: int) -> list[Kind]:
    """Up to ``times`` containers of a combination of classes, with exact lengths, as far as there are items.

    Of the first class the longest come first, of the next the shortest; the last item, whatever its
    class, is the longest that fits, so that classes cost no space.
    """
    heads = combo if len(combo) == 1 else combo[:-1]
    for c in set(heads):
        times = min(times, stock.classes[c] // heads.count(c))
    out: list[Kind] = []
    while times > 0:
        lengths: list[int] = []
        for k, c in enumerate(heads):
            low, high = (c - 1) * stock.width, min(c * stock.width, capacity)
            n = stock.longest(high, low, lengths) if k % 2 == 0 else stock.shortest(low, high, lengths)
            if n is None:
                return out
            lengths.append(n)
        if len(combo) > 1:
            n = stock.longest(capacity - sum(lengths), 0, lengths)
            if n is None:
                return out
            lengths.append(n)
        step = min(times, *(stock.left[n] // lengths.count(n) for n in lengths))
        items = None
        for n in lengths:
            items = (items, n, 1)
        out.append((step, items))
        times -= step
        for n in lengths:
            stock.take(n, step)
    return out


def _best_fit(kinds: list[Kind], stock: Stock, capacity: int) -> list[Kind]:
    """Puts the items left, longest first, where they leave the smallest gap; alike containers are handled together."""
    opened: dict[int, list[Kind]] = defaultdict(list)
    gaps = Ordered()

    def put(times: int, items: tuple | None, gap: int) -> None:
        opened[gap].append((times, items))
        gaps.add(gap)

    for times, items in kinds:
        put(times, items, capacity - sum(n * k for n, k in runs(items)))
    for n in sorted(stock.left, reverse=True):
        todo = stock.left[n]
        while todo:
            fit = gaps.up(n)
            if fit is not None:
                times, items = opened[fit].pop()
                if not opened[fit]:
                    gaps.discard(fit)
            else:
                times, items, fit = -(-todo // (capacity // n)), None, capacity
            each = min(fit // n, max(1, todo // times))
            take = min(times, todo // each)
            put(take, (items, n, each), fit - each * n)
            if take < times and items is not None:
                put(times - take, items, fit)
            todo -= take * each
    return [kind for own in opened.values() for kind in own]


def _lookup(kinds: list[Kind]) -> tuple[np.ndarray, ...]:
    """Arrays (length, first rank, per container, first container) sorted by length and rank."""
    rows, used, base = [], defaultdict(int), 0
    for times, items in kinds:
        for n, each in sorted(runs(items)):
            rows.append((n, used[n], each, base))
            used[n] += times * each
        base += times
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows)) if rows else tuple(np.zeros((4, 0), np.int64))


def pack(sized: DataFrame, containers: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(container, bin, doc_ids, starts, lens, fill): for each row of ``containers`` all items of ``sized`` (id, n_tokens) in bins.

    starts and lens tell the part, in tokens, of each item: the whole one unless it alone exceeds the
    capacity; it then fills bins of its own and its rest is packed as the others. Items of null or no
    tokens are left out. Containers need positive capacities and distinct names; alike rows count once.
    No items, no rows.

    What the driver plans with and broadcasts is a row or a few for each different length. There are no more
    of them than the capacity, nor than the square root of twice the tokens in all (seven million for
    100 TB of text), and GROUP kinds of containers are handled at a time.
    """
    limits = [(r["container"], int(r["capacity"])) for r in containers.where("capacity > 0").select("container", "capacity").distinct().orderBy("container", "capacity").collect()]
    if len({n for n, _ in limits}) < len(limits):
        raise ValueError("containers: two capacities under one name")
    held = sized.where("n_tokens > 0").select(F.col(id_column).alias("doc_id"), "n_tokens")
    if not limits:
        return _bins(_placed(held, [("", 1)], 1).limit(0))
    n = held.agg(F.sum(F.ceil(F.col("n_tokens") / min(c for _, c in limits)))).first()[0] or 0
    parts = max(PARTS, -(-n // PER_PART))
    out = None
    for at in range(0, len(limits), GROUP):
        own = _placed(held, limits[at : at + GROUP], parts)
        out = own if out is None else out.unionByName(own)
    return _bins(out)


def _bins(placed: DataFrame) -> DataFrame:
    """A row per bin; no more items in one than its capacity in tokens."""
    return (
        placed.groupBy("container", "bin")
        .agg(F.sort_array(F.collect_list(F.struct("doc_id", "start", "len"))).alias("held"), F.sum("len").alias("fill"))
        .select("container", "bin", F.col("held.doc_id").alias("doc_ids"), F.col("held.start").alias("starts"), F.col("held.len").alias("lens"), "fill")
    )


def _placed(held: DataFrame, limits: list[tuple[str, int]], parts: int) -> DataFrame:
    """(container, bin, doc_id, start, len) of every item or part of one, for each of ``limits`` (container, capacity)."""
    spark = held.sparkSession
    kinds = F.array(*(F.struct(F.lit(n).cast("string").alias("container"), F.lit(c).cast("bigint").alias("capacity")) for n, c in limits))
    each = held.withColumn("c", F.explode(kinds)).select("doc_id", "n_tokens", "c.container", "c.capacity")
    pieces = each.withColumn("start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_tokens") - 1, F.col("capacity"))))
    items = pieces.select("container", "doc_id", "start", F.least(F.col("capacity"), F.col("n_tokens") - F.col("start")).alias("len")).withColumn(
        "part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(parts)).cast("int")
    )
    counts = materialize(items.groupBy("container", "len", "part").agg(F.count(F.lit(1)).alias("n")), "histogram")
    histogram = counts.groupBy("container", "len").agg(F.sum("n").alias("n")).toPandas()
    own = {name: dict(zip(rows["len"].tolist(), rows["n"].tolist())) for name, rows in histogram.groupby("container")}
    tables = spark.sparkContext.broadcast({n: _lookup(plan_kinds(own.get(n, {}), c)) for n, c in limits})

    before = Window.partitionBy("container", "len").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("container", "len", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    number = F.row_number().over(Window.partitionBy("container", "len", "part").orderBy("doc_id", "start"))
    ranked = items.withColumn("own", number).join(offsets, ["container", "len", "part"]).select("container", "doc_id", "start", "len", (F.col("offset") + F.col("own") - 1).alias("rank"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, own in frame.groupby("container", sort=False):
                lengths, first, each, base = tables.value[name]
                high = int(max(first.max(), own["rank"].max())) + 1
                if high * (int(lengths.max()) + 1) < 2**62:
                    at = np.searchsorted(lengths * high + first, own["len"].to_numpy() * high + own["rank"].to_numpy(), "right") - 1
                else:  # ranks too large for one key
                    at = np.array([np.searchsorted(first[(a := np.searchsorted(lengths, n)) : np.searchsorted(lengths, n, "right")], r, "right") - 1 + a for n, r in zip(own["len"], own["rank"])])
                yield own.assign(bin=base[at] + (own["rank"].to_numpy() - first[at]) // each[at])[["container", "bin", "doc_id", "start", "len"]]

    kind = held.schema["doc_id"].dataType.simpleString()
    return ranked.mapInPandas(place, f"container string, bin bigint, doc_id {kind}, start bigint, len bigint")
