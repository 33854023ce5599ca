"""A numbered list of JSON entries in a folder, each added by one atomic rename.

The rename is atomic on HDFS and on file systems that share its contract. A plain object store
copies instead: there the folder must lie behind a committer or a table format that refuses a
second writer of the same name.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Manifest:
    """Entries 0, 1, 2, … under ``folder``; of two writers of the same number one fails.

    Entries never change, so each is read once by an object of this class, however often it looks.
    """

    def __init__(self, spark: SparkSession, folder: str):
        jvm = spark.sparkContext._jvm
        self._spark, self._jvm, self._path = spark, jvm, jvm.org.apache.hadoop.fs.Path
        self.folder = folder.rstrip("/")
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.folder).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(self.folder))
        self._read: dict[str, dict] = {}

    def entries(self) -> list[dict]:
        found = {}
        for status in self._fs.listStatus(self._path(self.folder)):
            name = status.getPath().getName()
            if name.endswith(".json"):
                found[name] = status.getPath()
        for name in sorted(found.keys() - self._read.keys()):
            stream = self._fs.open(found[name])
            self._read[name] = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
        return [self._read[name] for name in sorted(found)]

    def add(self, number: int, entry: dict) -> None:
        draft = self._fs.makeQualified(self._path(f"{self.folder}/.{uuid.uuid4().hex}"))
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        final = self._fs.makeQualified(self._path(f"{self.folder}/{number:012d}.json"))
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf)
        plain = self._spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(draft, final, plain)  # without OVERWRITE it refuses an existing name
