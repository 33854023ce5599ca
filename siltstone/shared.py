"""Working tables in the folder that all executors share.

Lineage is cut by writing a table, never by a local checkpoint: a lost executor
then costs a read, not the job.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def one_process(spark: SparkSession) -> bool:
    """Whether tasks run in the driver's own process: a plain local master."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def own_folder() -> str:
    """A new folder of the driver's machine, deleted when it ends."""
    made = tempfile.mkdtemp(prefix="siltstone-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a plain local master may fall back to a new one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not one_process(spark):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    made = own_folder()
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return spark.sparkContext.getCheckpointDir()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path for one working table of this application."""
    return f"{shared_folder(spark)}/siltstone/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def unused(name: str, *tables: DataFrame) -> str:
    """A column name like ``name`` that none of the tables has."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame, key: str) -> DataFrame:
    """A plain scan for costly work on each row: one in fewer partitions than there are cores is dealt out by ``key``, others stay.

    Of a small table in one file a single task would do all; a large one has partitions enough and isn't moved.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, key) if scan.rdd.getNumPartitions() < cores else scan


def release(spark: SparkSession) -> None:
    """Delete the working tables of this application."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/siltstone/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
