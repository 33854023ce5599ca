"""Applying a feed of inserts, updates and deletes, newest first."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.shared import materialize


def _unresolved(df: DataFrame, resolved: DataFrame, keys: Sequence[str]) -> DataFrame:
    r = resolved.select(*(F.col(k).alias(f"__r_{k}") for k in keys))
    return df.join(r, reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys)), "left_anti")


def apply_changes(
    changes: DataFrame, keys: Sequence[str], time: Column, then: Sequence[Column], writes: Column, removes: Column, image: Sequence[str], base: DataFrame | None = None, slices: int = 4
) -> DataFrame:
    """(keys, image): the table's state after all changes.

    changes apply in order of ``time`` and then of ``then``; ``writes`` and ``removes`` tell what a
    change does, others are ignored. The feed is cut at quantiles of time into ``slices``, which are
    taken from the newest back. In each, the last change of every key is found (combined before
    the shuffle, so a hot key is one row per task), keys settled by a newer slice are taken out by
    an anti-join, and the image or tombstone that is left is recorded in a table in the shared
    folder. Rows of ``base`` whose keys no change touches are appended as they are.

    Keys are compared null-safe; changes without time are older than any other; alike changes
    count once; of changes with the same order the one with the greatest image counts. An empty
    feed gives the base, or no rows. Columns not named are ignored.
    """
    acts = changes.select(*keys, time.alias("__t"), F.struct(*(c.alias(f"o{i}") for i, c in enumerate(then))).alias("__o"), writes.alias("__w"), *(F.col(c).alias(f"__i_{c}") for c in image), removes.alias("__d")).where("__w or __d")
    acts = materialize(acts, "feed")  # each slice reads it, whatever the feed is made of
    inner = [i / slices for i in range(1, slices)]
    cuts = sorted(set(acts.approxQuantile("__t", inner, 0.01))) if inner else []
    bounds = [None, *cuts, None]
    settled: DataFrame | None = None
    for low, high in reversed(list(zip(bounds, bounds[1:]))):
        part = acts
        if high is not None:
            part = part.where((F.col("__t") < high) if low is not None else ((F.col("__t") < high) | F.col("__t").isNull()))
        if low is not None:
            part = part.where(F.col("__t") >= low)
        last = part.groupBy(*keys).agg(F.max(F.struct("__t", "__o", "__w", *(f"__i_{c}" for c in image))).alias("__last"))
        if settled is not None:
            last = _unresolved(last, settled, keys)
        last = materialize(last.select(*keys, F.col("__last.__w").alias("__w"), *(F.col(f"__last.__i_{c}").alias(c) for c in image)), "changes")
        settled = last if settled is None else settled.unionByName(last)
    state = settled.where("__w").drop("__w")
    if base is not None:
        state = state.unionByName(_unresolved(base.select(*keys, *image), settled, keys))
    return state
