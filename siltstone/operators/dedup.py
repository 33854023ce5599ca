"""Keeping one copy of messages that were delivered at least once.

The identifiers held so far are an index: immutable runs, each a table of sorted identifier
arrays split by hash prefix. A batch is first reduced to one row per identifier, then looked
up by binary search in the arrays of its prefixes; what is new, or better than the copy held,
becomes a new run, with prefixes as fine as its own size asks for. Runs are merged from time to time, which splits
prefixes again.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.manifest import Manifest
from siltstone.shared import unused

#: Identifiers of one prefix that a task holds in memory at a time (24 bytes each).
PER_PREFIX = 1_000_000
#: Most bits of a prefix: the folders of a run.
MOST_BITS = 18


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64("id"), 64 - bits).cast("int") if bits else F.lit(0)


def _probe(runs: Sequence[tuple[str, int]], fine: int):
    """A mapInArrow function adding (held_stamp, held_row) to rows sorted by prefix of ``fine`` bits; null where the identifier is new.

    Each of the ``runs`` (path, bits) has its own, coarser prefixes; its arrays stay in memory as long as the rows fall in one.
    """

    def arrays(run: str, prefix: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        found = []
        system, root = fs.FileSystem.from_uri(run)
        for info in system.get_file_info(fs.FileSelector(f"{root}/prefix={prefix}", allow_not_found=True)):
            if info.base_name.endswith(".parquet"):
                with system.open_input_file(info.path) as file:
                    t = pq.ParquetFile(file).read(columns=["id", "stamp", "row"])
                found.append(tuple(t[c].to_numpy() for c in ("id", "stamp", "row")))
        return found

    def run_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: list[int | None] = [None] * len(runs)
        held: list[list] = [[] for _ in runs]
        for batch in batches:
            if not batch.num_rows:
                continue
            prefixes, ids = batch["prefix"].to_numpy(), batch["id"].to_numpy(zero_copy_only=False)
            stamp, row = np.full(len(ids), np.nan), np.full(len(ids), -1, np.int64)
            hit = np.zeros(len(ids), bool)
            edges = np.flatnonzero(np.r_[True, prefixes[1:] != prefixes[:-1], True])
            for a, b in zip(edges[:-1], edges[1:]):
                for i, (run, bits) in enumerate(runs):
                    coarse = int(prefixes[a]) >> (fine - bits)
                    if coarse != at[i]:
                        at[i], held[i] = coarse, arrays(run, coarse)
                for known, stamps, rows in (x for own in held for x in own):
                    if not len(known):
                        continue
                    place = np.minimum(np.searchsorted(known, ids[a:b]), len(known) - 1)
                    same = known[place] == ids[a:b]
                    better = same & (~hit[a:b] | (stamps[place] < stamp[a:b]) | ((stamps[place] == stamp[a:b]) & (rows[place] < row[a:b])))
                    stamp[a:b][better], row[a:b][better] = stamps[place[better]], rows[place[better]]
                    hit[a:b] |= same
            extra = [pa.array(stamp, mask=~hit), pa.array(row, mask=~hit)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "held_stamp", "held_row"])

    return run_over


class IdentifierIndex:
    """The identifiers seen so far with the copy kept of each: the one with the least (stamp, row).

    Batches are DataFrames with the columns id (integer or string, not null), stamp (double; null,
    NaN and infinite are the last) and row (bigint, unique). The prefixes of a run follow its own number of
    identifiers, so that about ``per_prefix`` of them share one, whatever the first batch was like.
    """

    def __init__(self, spark: SparkSession, folder: str, merge_at: int = 8, per_prefix: int = PER_PREFIX):
        self.spark, self.folder, self.merge_at, self.per_prefix = spark, folder.rstrip("/"), merge_at, per_prefix
        self._manifest = Manifest(spark, f"{self.folder}/manifest")

    def _state(self) -> dict:
        entries = self._manifest.entries()
        return {**(entries[-1] if entries else {"kind": None, "runs": []}), "n": len(entries), "batches": {e["batch"] for e in entries}}

    def _bits(self, n: int) -> int:
        return max(0, min(MOST_BITS, math.ceil(math.log2(max(1, n / self.per_prefix)))))

    def _arranged(self, entries: DataFrame, bits: int) -> DataFrame:
        """The rows in adjoining ranges of prefixes, at least four a core, each sorted by prefix and identifier."""
        tasks = max(4 * self.spark.sparkContext.defaultParallelism, min(2**bits, 65536))
        place = F.shiftrightunsigned(F.shiftrightunsigned(F.xxhash64("id"), 32) * F.lit(tasks), 32).cast("int")
        return entries.repartitionById(tasks, place).withColumn("prefix", _prefix(bits)).sortWithinPartitions("prefix", "id")

    def _write(self, entries: DataFrame, bits: int) -> str:
        """A run; a prefix spread over several tasks has as many sorted arrays, in a file each."""
        path = f"{self.folder}/runs/{uuid.uuid4().hex}"
        self._arranged(entries, bits).select("prefix", "id", "stamp", "row").write.partitionBy("prefix").parquet(path)
        return path

    def ingest(self, batch: DataFrame, name: str) -> None:
        """Take in the batch called ``name``; one that was taken in before changes nothing."""
        state = self._state()
        if name in state["batches"]:
            return
        bits = self._bits(batch.count())
        stamp = F.when(F.isnan("stamp") | F.col("stamp").isNull(), F.lit(float("inf"))).otherwise(F.col("stamp"))
        first = batch.select("id", F.struct(stamp.alias("stamp"), "row").alias("copy")).groupBy("id").agg(F.min("copy").alias("copy")).select("id", "copy.stamp", "copy.row")
        kind = first.schema["id"].dataType.simpleString()
        if state["runs"]:
            runs = [(r["path"], r["bits"]) for r in state["runs"]]
            fine = max(bits, *(b for _, b in runs))
            shape = f"id {kind}, stamp double, row bigint, prefix int, held_stamp double, held_row bigint"
            seen = self._arranged(first, fine).select("id", "stamp", "row", "prefix").mapInArrow(_probe(runs, fine), shape)
            first = seen.where("held_row is null or stamp < held_stamp or (stamp = held_stamp and row < held_row)").select("id", "stamp", "row")
        runs = [*state["runs"], {"path": self._write(first, bits), "bits": bits}]
        self._manifest.add(state["n"], {"kind": kind, "runs": runs, "batch": name})
        if len(runs) >= self.merge_at:
            self.merge()

    def _entries(self, runs: list[dict], kind: str) -> DataFrame:
        parts = [self.spark.read.schema(f"id {kind}, stamp double, row bigint").parquet(r["path"]).select("id", "stamp", "row") for r in runs]  # a run may be empty
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        return df

    def merge(self) -> None:
        """Merge all runs into one; of an identifier in several the least copy stays. Prefixes are split as its size asks for."""
        state = self._state()
        if len(state["runs"]) < 2:
            return
        entries = self._entries(state["runs"], state["kind"])
        bits = self._bits(entries.count())  # from footers
        best = entries.groupBy("id").agg(F.min(F.struct("stamp", "row")).alias("copy")).select("id", "copy.stamp", "copy.row")
        run = {"path": self._write(best, bits), "bits": bits}
        self._manifest.add(state["n"], {"kind": state["kind"], "runs": [run], "batch": None})

    def vacuum(self) -> None:
        """Delete the runs that merging has replaced; call it when nothing reads them any more."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/runs")
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        live = {r["path"].rsplit("/", 1)[1] for r in self._state()["runs"]}
        for status in files.listStatus(folder):
            if status.getPath().getName() not in live:
                files.delete(status.getPath(), True)

    def kept(self) -> DataFrame:
        """(id, stamp, row) of the copy kept of each identifier."""
        state = self._state()
        runs = state["runs"]
        if not runs:
            return self.spark.createDataFrame([], "id bigint, stamp double, row bigint")
        entries = self._entries(runs, state["kind"])
        if len(runs) == 1:
            return entries
        return entries.groupBy("id").agg(F.min(F.struct("stamp", "row")).alias("copy")).select("id", "copy.stamp", "copy.row")


def split_copies(messages: DataFrame, index: IdentifierIndex, ident: str, row: str, stamp: str | None, batch: str | None = None, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): the rows of ``messages`` that stay and those that repeat an identifier.

    Of each identifier the copy with the least ``stamp`` (nulls last), then the least ``row`` stays,
    in whatever batch it came; rows without identifier all stay. The table is taken in as a backlog
    of ``rounds`` parts, cut at quantiles of ``batch``, whose runs are merged at the end. Dropped rows are found by their unique
    ``row``, so a hot identifier doesn't make a hot task. An empty table gives two empty results;
    extra columns come along unchanged.
    """
    known = messages.where(F.col(ident).isNotNull())
    entry = known.select(F.col(ident).alias("id"), (F.col(stamp) if stamp else F.lit(None)).cast("double").alias("stamp"), F.col(row).cast("bigint").alias("row"), *([F.col(batch).alias("__b")] if batch else []))
    cuts = sorted(set(entry.approxQuantile("__b", [i / rounds for i in range(1, rounds)], 0.01))) if batch and rounds > 1 else []
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = entry
        if low is not None:
            part = part.where(F.col("__b") > low)
        if high is not None:
            upto = F.col("__b") <= high
            part = part.where(upto if low is not None else upto | F.col("__b").isNull())
        index.ingest(part.select("id", "stamp", "row"), f"{low}..{high}")
    index.merge()
    own = unused("held_row", messages)
    held = index.kept().select(F.col("row").alias(own))
    dropped = known.join(held, F.col(row) == F.col(own), "left_anti")
    kept = known.join(held, F.col(row) == F.col(own), "left_semi").unionByName(messages.where(F.col(ident).isNull()))
    return kept, dropped
