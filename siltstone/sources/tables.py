"""Tables of other kinds: stored copies, remote tables, sinks, catalogue."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators.joins import union_tables
from siltstone.shared import materialize, one_process, scratch


def blocks(df: DataFrame, size: int = 65536) -> Iterator[list[Row]]:
    """Block scan: lists of up to ``size`` rows, one partition at a time on the driver; an empty list at the end."""
    block: list[Row] = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block
    yield []


def jdbc_options(url: str, table: str, user: str = "", password: str = "", split: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 64) -> dict[str, str]:
    """Options of a remote table read or written by ``format('jdbc')``; with ``split``, a numeric column, it is read in parallel ranges."""
    options = {"url": url, "dbtable": table, "fetchsize": "10000", "batchsize": "10000"}
    options |= {k: v for k, v in (("user", user), ("password", password)) if v}
    if split:
        if bounds is None:
            raise ValueError("a split column needs its bounds")
        options |= {"partitionColumn": split, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(parts)}
    return options


def remote_table(spark: SparkSession, **given) -> DataFrame:
    """A remote table; one that only the driver's process reaches is fetched through it."""
    remote = spark.read.format("jdbc").options(**jdbc_options(**given)).load()
    return remote if in_reach(spark, given["url"]) else fetched(remote, **given)


def append_remote(df: DataFrame, **given) -> None:
    """Rows appended by all executors, or by the driver where only its process reaches the database."""
    if in_reach(df.sparkSession, given["url"]):
        df.write.format("jdbc").options(**jdbc_options(**given)).mode("append").save()
    else:
        append_blocks(df, **given)


def in_reach(spark: SparkSession, url: str) -> bool:
    """Whether executors reach a database: an embedded one lives in the process that opens it."""
    return one_process(spark) or not url.startswith("jdbc:derby:") or url.startswith("jdbc:derby://")


def fetched(remote: DataFrame, size: int = 10_000, **given) -> DataFrame:
    """A remote table read by the driver, ``size`` rows at a time, into a working table."""
    spark, schema = remote.sparkSession, remote._jdf.schema()
    jvm, path = spark.sparkContext._jvm, scratch(remote.sparkSession, "fetched")
    with _connected(spark, given) as (connection, dialect, options):
        found = connection.createStatement().executeQuery(f"select * from {options.tableOrQuery()}")
        rows = jvm.org.apache.spark.sql.execution.datasources.jdbc.JdbcUtils.resultSetToRows(found, schema, dialect).grouped(size)
        spark.createDataFrame([], remote.schema).write.parquet(path)
        while rows.hasNext():
            block = spark._jsparkSession.createDataFrame(jvm.scala.jdk.javaapi.CollectionConverters.asJava(rows.next()), schema)
            DataFrame(block, spark).write.mode("append").parquet(path)
    return spark.read.schema(remote.schema).parquet(path)


def append_blocks(df: DataFrame, size: int = 10_000, **given) -> None:
    """Rows appended to a remote table by the driver, ``size`` rows at a time and in one transaction; the table is made if there is none."""
    spark = df.sparkSession
    jvm, schema = spark.sparkContext._jvm, df._jdf.schema()
    plain = dict.fromkeys((T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType, T.BooleanType), lambda v: v)
    texts = {T.DecimalType: lambda v: jvm.java.math.BigDecimal(str(v)), T.DateType: lambda v: jvm.java.sql.Date.valueOf(str(v)), T.TimestampNTZType: lambda v: jvm.java.sql.Timestamp.valueOf(str(v))}
    given_as = [(plain | texts).get(type(f.dataType)) for f in df.schema]
    if None in given_as:
        raise ValueError(f"{df.columns[given_as.index(None)]}: its type can't be written to an embedded database")
    utils = jvm.org.apache.spark.sql.execution.datasources.jdbc.JdbcUtils
    with _connected(spark, given) as (connection, dialect, options):
        connection.setAutoCommit(False)
        try:
            known = utils.getSchemaOption(connection, options)
            if known.isEmpty():
                utils.createTable(connection, options.table(), schema, False, options)
            statement = connection.prepareStatement(utils.getInsertStatement(options.table(), schema, known, False, dialect))
            for block in blocks(df, size):
                for row in block:
                    for i, (v, to) in enumerate(zip(row, given_as), 1):
                        statement.setObject(i, None if v is None else to(v))
                    statement.addBatch()
                if block:
                    statement.executeBatch()
            connection.commit()
        except BaseException:
            connection.rollback()
            raise


@contextmanager
def _connected(spark: SparkSession, given: dict) -> Iterator[tuple]:
    """The driver's own connection to a remote table, with Spark's dialect and options for it."""
    jvm = spark.sparkContext._jvm
    options = jvm.org.apache.spark.sql.execution.datasources.jdbc.JdbcOptionsInWrite(jvm.PythonUtils.toScalaMap(jdbc_options(**given)))
    dialect = jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(given["url"])
    connection = dialect.createConnectionFactory(options).apply(-1)
    try:
        yield connection, dialect, options
    finally:
        connection.close()


def discard(df: DataFrame) -> None:
    """Blackhole: computes every row and keeps none."""
    df.write.format("noop").mode("overwrite").save()


def archive(df: DataFrame, path: str) -> None:
    """Append-only compressed rows."""
    df.write.mode("append").option("compression", "zstd").parquet(path)


def backup(tables: dict[str, DataFrame], folder: str) -> None:
    """A snapshot: each table under ``folder`` and a content index with its rows, written last."""
    spark = next(iter(tables.values())).sparkSession
    index = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        index.append((name, spark.read.parquet(f"{folder}/{name}").count(), df.schema.simpleString()))
    spark.createDataFrame(index, "name string, rows bigint, columns string").coalesce(1).write.mode("overwrite").json(f"{folder}/_index")


def restore(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a snapshot; one whose rows don't match the index is refused."""
    out = {}
    for r in spark.read.json(f"{folder}/_index").collect():  # a row per table
        df = spark.read.parquet(f"{folder}/{r['name']}")
        if df.count() != r["rows"]:
            raise ValueError(f"{r['name']}: not {r['rows']} rows")
        out[r["name"]] = df
    return out


def merge_table(spark: SparkSession, *paths: str) -> DataFrame:
    """Several Parquet tables of one schema as one."""
    return union_tables(*(spark.read.parquet(p) for p in paths))


def file_text(spark: SparkSession, path: str) -> DataFrame:
    """LOAD_FILE: one row with the content of each file, as bytes."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def columns_of(spark: SparkSession, views: list[str]) -> DataFrame:
    """INFORMATION_SCHEMA.COLUMNS of the named views: (table_name, ordinal_position, column_name, data_type)."""
    rows = [(v, i, f.name, f.dataType.simpleString()) for v in views for i, f in enumerate(spark.table(v).schema, 1)]
    return spark.createDataFrame(rows, "table_name string, ordinal_position int, column_name string, data_type string")


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """EXPLAIN."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def guard(df: DataFrame, most_bytes: int) -> DataFrame:
    """Safe select: refuses a query whose estimated size is above ``most_bytes``."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > most_bytes:
        raise ValueError(f"the query would read or make about {size} bytes; {most_bytes} are allowed")
    return df


def number_rows(df: DataFrame, name: str = "id", start: int = 1, held: bool = False) -> DataFrame:
    """AUTO_INCREMENT: consecutive numbers from ``start`` in the order of partitions; one count per partition, no shuffle of rows.

    Partitions are counted in a run of their own. Rows that may fall in others when run again, as
    after a sort, whose ranges are sampled each time, must be ``held``: stored once with their places.
    """
    ids = df.withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id())
    if held:
        ids = materialize(ids, "numbered")
    sizes = ids.groupBy("__p").agg(F.count(F.lit(1)).alias("n"), F.min("__m").alias("first")).orderBy("__p").collect()  # a row per partition
    base, pairs = start, []
    for r in sizes:
        pairs += [F.lit(r["__p"]), F.lit(base - r["first"])]
        base += r["n"]
    shift = F.create_map(*pairs)[F.col("__p")] if pairs else F.lit(0)
    return ids.withColumn(name, F.col("__m") + shift).drop("__p", "__m")
