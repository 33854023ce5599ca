"""Processing only new or changed records.

Two parts. :func:`unread_objects` compares versioned deliveries with a log of runs and
gives the objects whose newest state no successful run has read. :class:`CommitLog` runs
a transformation over what lies between the last committed watermark and an upper limit
fixed at the start, and commits output and watermark in one atomic step.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions.instants import epoch_micros
from siltstone.manifest import Manifest

#: Most buckets of time that a run may be spread over.
BUCKETS = 65536
#: Tables of earlier runs that are read side by side before they are merged into one.
MERGE_AT = 16
#: The least and greatest id.
LEAST, MOST = -(2**63), 2**63 - 1


def complete_lists(lists: DataFrame) -> DataFrame:
    """(list_id, received_us) of the complete lists; lists repeated alike count once, received_us may be null."""
    return lists.where("done and list_id is not null").select("list_id", epoch_micros(lists, "received_at").alias("received_us")).distinct()


def read_tiles(complete: DataFrame, runs: DataFrame) -> DataFrame:
    """(list_id, lo, hi, read): the whole range of ids of each complete list in disjoint tiles, and whether successful runs read them.

    A run covers a span of time (from_at excluded, cut_at included), so lists and runs meet on
    buckets of time as wide as the mean span, at most BUCKETS of them: an equi-join, in which a run
    takes part about three times. Rows with a null bound or done other than true read nothing; a
    list with no received_at is complete but read by no run. The ranges of a list are laid side by
    side by running over them in order, so they are never held together.
    """
    done = runs.where("done").select(
        epoch_micros(runs, "from_at").alias("after_us"), epoch_micros(runs, "cut_at").alias("upto_us"), F.col("from_obj_id").alias("l"), F.col("upto_obj_id").alias("h")
    ).where("after_us < upto_us and l <= h").distinct()
    mean, first, last = done.agg(F.avg(F.col("upto_us") - F.col("after_us")), F.min("after_us"), F.max("upto_us")).first()
    width = max(1, int(mean or 1), ((last or 0) - (first or 0)) // BUCKETS)
    bucket = lambda c: F.floor(F.col(c) / F.lit(width)).cast("bigint")
    spread = done.withColumn("bucket", F.explode(F.sequence(bucket("after_us"), bucket("upto_us"))))
    met = complete.withColumn("bucket", bucket("received_us")).join(spread, "bucket").where("after_us < received_us and received_us <= upto_us").select("list_id", "l", "h")
    gap = F.lit(None).cast("bigint")
    rows = met.unionByName(complete.select("list_id", gap.alias("l"), gap.alias("h"))).distinct()
    w = Window.partitionBy("list_id").orderBy("l", "h")  # the row without range comes first
    ran = rows.withColumn("before", F.max("h").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("upto", F.max("h").over(w)).withColumn("next", F.lead("l").over(w))
    after = lambda c: F.when(F.col(c).isNull(), F.lit(LEAST)).when(F.col(c) < F.lit(MOST), F.col(c) + 1)
    until = F.when(F.col("next").isNull(), F.lit(MOST)).when(F.col("next") > F.lit(LEAST), F.col("next") - 1)
    tile = lambda lo, hi, read: F.when(lo <= hi, F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(read).alias("read")))
    both = F.array(tile(F.greatest("l", after("before")), F.col("h"), True), tile(after("upto"), until, False))
    return ran.select("list_id", F.inline(F.array_compact(both)))


def deliveries(pairs: DataFrame, meta: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """(list_id, obj_id, version) once for each pair, of ``lists`` if given; version is the newest timestamp of its meta rows, or null.

    Union and aggregation instead of a join: repeated rows and hot lists shrink before the
    shuffle. Pairs without list_id or obj_id aren't deliveries; a NaN timestamp counts as missing.
    """
    stamp = F.when(~F.isnan("timestamp"), F.col("timestamp"))
    both = pairs.select("list_id", "obj_id", F.lit(None).cast("double").alias("version"), F.lit(True).alias("held")).unionByName(
        meta.select("list_id", "obj_id", stamp.alias("version"), F.lit(False).alias("held"))
    )
    if lists is not None:
        both = both.join(lists.select("list_id"), "list_id", "left_semi")
    return (
        both.where("list_id is not null and obj_id is not null")
        .groupBy("list_id", "obj_id")
        .agg(F.max("version").alias("version"), F.max("held").alias("held"))
        .where("held")
        .drop("held")
    )


def newest_states(pairs: DataFrame, meta: DataFrame, complete: DataFrame, runs: DataFrame, only: bool = False) -> DataFrame:
    """(obj_id, version, read) of each object delivered by the ``complete`` lists: its newest version, and whether a run read any delivery of that.

    A delivery falls in exactly one tile of its list. One aggregation per object, combined before
    the shuffle; nulls are the oldest version. ``only`` says that the lists are few among all, so
    that pairs are sifted before they are aggregated.
    """
    found = deliveries(pairs, meta, complete if only else None).alias("d").join(read_tiles(complete, runs).alias("t"), F.expr("d.list_id = t.list_id and d.obj_id between t.lo and t.hi"))
    return found.groupBy("obj_id").agg(F.max(F.struct("version", "read")).alias("newest")).select("obj_id", "newest.version", "newest.read")


def unread_objects(pairs: DataFrame, meta: DataFrame, lists: DataFrame, runs: DataFrame, limit: int | None = None) -> DataFrame:
    """(obj_id, version) of the objects with deliveries none of which, among those of the newest version, was read.

    Lists received after ``limit`` (microseconds) don't count yet; one with no received_at does.
    Empty tables give no rows; an empty run log gives every delivered object. Other columns are ignored.
    """
    complete = complete_lists(lists)
    if limit is not None:
        complete = complete.where(F.coalesce(F.col("received_us") <= F.lit(limit), F.lit(True)))
    return newest_states(pairs, meta, complete, runs).where("not read").drop("read")


def last_received(lists: DataFrame) -> int | None:
    """The greatest time at which a complete list was received, in microseconds."""
    return lists.where("done").agg(F.max(epoch_micros(lists, "received_at"))).first()[0]


class CommitLog:
    """Exactly-once batches over a source.

    ``folder`` holds ``data/`` (outputs, some perhaps of failed runs), ``taken/`` (what each run took
    in) and ``commits/`` (a manifest with the watermark and the output of each run). Adding an entry
    to the manifest is atomic, so output and watermark become visible together or not at all, and of
    two runs racing for a number one fails. What a failed run wrote is never read; the next run
    repeats its records.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._manifest = Manifest(spark, f"{self.folder}/commits")

    def commits(self) -> list[dict]:
        """The committed runs in order."""
        return self._manifest.entries()

    def _store(self, rows: DataFrame, kind: str, number: int) -> str:
        path = f"{self.folder}/{kind}/{number:012d}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path

    def _commit(self, done: list[dict], watermark: int | float | str | None, path: str, **more) -> dict:
        entry = {"run": len(done), "after": done[-1]["watermark"] if done else None, "watermark": watermark, "path": path, **more}
        self._manifest.add(len(done), entry)
        return entry

    def run(self, source: DataFrame, sequence: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, key: Sequence[str] = ()) -> dict | None:
        """Process the rows with watermark < sequence <= limit; None where there are none.

        ``sequence`` is a commit sequence: a row may arrive late only with the sequence that is the
        watermark, and only if ``key`` (columns that tell rows apart) is given: the keys taken at the
        watermark are then kept beside it, and rows of that sequence with other keys are new. The limit is the
        greatest sequence at the start. Rows whose sequence is null never qualify; what has no
        monotonic sequence is taken in by :meth:`take_unread`, which makes its own.
        """
        done = self.commits()
        fresh = source.where(F.col(sequence).isNotNull())
        if done:
            mark, edge = F.lit(done[-1]["watermark"]), done[-1].get("edge")
            fresh = fresh.where(F.col(sequence) >= mark if edge else F.col(sequence) > mark)
            if edge:
                held = self.spark.read.parquet(edge).select(*(F.col(k).alias(f"__{k}") for k in key)).distinct()
                same = F.col(sequence) == mark
                for k in key:
                    same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
                fresh = fresh.join(held, same, "left_anti")
        limit = fresh.agg(F.max(sequence)).first()[0]
        if limit is None:
            return None
        fresh = fresh.where(F.col(sequence) <= F.lit(limit))
        if not key:
            return self._commit(done, limit, self._store(transform(fresh), "data", len(done)))
        fresh = self.spark.read.schema(fresh.schema).parquet(self._store(fresh, "taken", len(done)))  # what arrives meanwhile is left to the next run
        edge = fresh.where(F.col(sequence) == F.lit(limit)).select(*key)
        if done and done[-1].get("edge") and done[-1]["watermark"] == limit:
            edge = edge.unionByName(self.spark.read.parquet(done[-1]["edge"]))
        return self._commit(done, limit, self._store(transform(fresh), "data", len(done)), edge=self._store(edge.distinct(), "taken", len(done)))

    def _earlier(self, done: list[dict], kind: str) -> list[str]:
        return done[-1].get(kind, []) if done else []

    def _merged(self, paths: list[str], kind: str, number: int, merge: Callable[[DataFrame], DataFrame]) -> list[str]:
        return [self._store(merge(self.spark.read.parquet(*paths)), kind, number)] if len(paths) >= MERGE_AT else paths

    def take_unread(self, pairs: DataFrame, meta: DataFrame, lists: DataFrame, runs: DataFrame, before_commit: Callable[[], None] = lambda: None) -> dict:
        """One run over versioned deliveries: commits (obj_id, version) of all objects unread so far, by ``runs`` and by this log.

        The commit sequence is the log's own: a list gets the number of the run that first sees it
        complete, which no clock of a sender can upset. The lists in the ledger lie below the
        watermark; those complete at the start and not in it are written down first and are the
        upper limit, so lists that arrive late, at the very time of the watermark or with no
        received_at, or become complete later, are taken in once like any other. Only their pairs
        are read. Beside its output a run keeps the newest version of every object that its lists
        touched, read or taken: an object comes again only with a newer one. Ledger and versions
        are merged every MERGE_AT runs. Output, ledger, versions and watermark are committed by one entry; a run
        that fails leaves none and the next takes the same lists. A run with nothing to take commits
        no rows. A complete list doesn't change; pairs added to one that was taken in aren't seen.
        """
        done = self.commits()
        number = len(done)
        complete, ledger = complete_lists(lists), self._earlier(done, "ledger")
        if ledger:
            known = self.spark.read.parquet(*ledger).select(F.col("list_id").alias("l"), F.col("received_us").alias("r"))
            complete = complete.join(known, (F.col("list_id") == F.col("l")) & F.col("received_us").eqNullSafe(F.col("r")), "left_anti")
        taken = self._store(complete, "taken", number)
        fresh = self.spark.read.schema("list_id bigint, received_us bigint").parquet(taken)
        states = newest_states(pairs, meta, fresh, runs, only=bool(done)).select("obj_id", "version", (~F.col("read")).alias("taken"))
        versions = self._earlier(done, "versions")
        if versions:
            states = states.join(_newest(self.spark.read.parquet(*versions)), F.col("obj_id") == F.col("o"), "left").where(_newer()).drop("o", "v")
        path = self._store(states, "data", number)
        ledger = self._merged([*ledger, taken], "taken", number, lambda df: df.distinct())
        versions = self._merged([*versions, path], "versions", number, lambda df: _newest(df).withColumnsRenamed({"o": "obj_id", "v": "version"}))
        before_commit()
        return self._commit(done, number, path, ledger=ledger, versions=versions, taken=True)

    def output(self, since: int = 0) -> DataFrame | None:
        """The committed output of the runs from number ``since`` on."""
        own = self.commits()[since:]
        if not own:
            return None
        rows = self.spark.read.parquet(*(c["path"] for c in own))
        return rows.where("taken").drop("taken") if own[0].get("taken") else rows


def _newest(states: DataFrame) -> DataFrame:
    return states.groupBy(F.col("obj_id").alias("o")).agg(F.max("version").alias("v"))


def _newer() -> Column:
    """Whether a version is newer than the one known of its object; null is the oldest."""
    return F.col("o").isNull() | (F.col("version").isNotNull() & (F.col("v").isNull() | (F.col("version") > F.col("v"))))
