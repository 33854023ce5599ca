"""Streams: windows over event time, periodic statements and row-range messages taken in once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.manifest import Manifest


def tumbling(events: DataFrame, time: str, size: str, *keys: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """(window_start, keys, n, total) over windows of ``size``; the same for tables and, with ``late`` as watermark, for streams."""
    if late:
        events = events.withWatermark(time, late)
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    """(key, session_start, session_end, n): runs of events with pauses below ``gap``."""
    if late:
        events = events.withWatermark(time, late)
    return events.groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def every(stream: DataFrame, interval: str, statement: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """CREATE EVENT … EVERY interval DO statement: runs it on each micro-batch."""
    return stream.writeStream.trigger(processingTime=interval).option("checkpointLocation", checkpoint).foreachBatch(statement).start()


class RangeInbox:
    """Data messages known by a row-id range: one that overlaps a range taken in before is refused, a failed one may come again."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._manifest = Manifest(spark, f"{self.folder}/ranges")

    def take(self, rows: DataFrame, first: int, last: int) -> bool:
        """Store the rows of [first, last]; False if any of that range is held."""
        held = self._manifest.entries()
        if any(e["first"] <= last and first <= e["last"] for e in held):
            return False
        path = f"{self.folder}/data/{first}-{last}-{len(held)}"
        rows.write.mode("overwrite").parquet(path)
        self._manifest.add(len(held), {"first": first, "last": last, "path": path})
        return True

    def rows(self) -> DataFrame | None:
        paths = [e["path"] for e in self._manifest.entries()]
        return self.spark.read.parquet(*paths) if paths else None
