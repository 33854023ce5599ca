"""Delimited and binary text: load and export with the reference's options."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class TextFormat:
    """How fields and lines are written; the defaults are the reference's."""

    delimiter: str = ";"
    enclosure: str = '"'
    escape: str = "\\"
    null: str = "\\N"
    line: str = "\n"
    charset: str = "UTF-8"
    skip: int = 0
    starter: str = ""


def load(spark: SparkSession, path: str, schema: T.StructType, fmt: TextFormat = TextFormat()) -> DataFrame:
    """LOAD DATA INFILE: the rows with the columns of ``schema`` and _error, the text of a line that doesn't fit, else null.

    A byte order mark and the first ``skip`` lines of each file are left out, as is ``starter`` before
    a line; a line without it is an error. Large files are split between tasks.
    """
    ready = T.StructType([*schema.fields, T.StructField("_error", T.StringType())])
    options = {"sep": fmt.delimiter, "quote": fmt.enclosure, "escape": fmt.escape, "nullValue": fmt.null, "columnNameOfCorruptRecord": "_error", "mode": "PERMISSIVE", "columnPruning": "false", "encoding": fmt.charset, "emptyValue": ""}
    if fmt.charset.upper() not in ("UTF-8", "UTF8"):
        if fmt.skip or fmt.starter:
            raise ValueError("skipped lines and line starters need UTF-8")
        return spark.read.schema(ready).options(**options).csv(path)
    lines = spark.read.text(path, lineSep=None if fmt.line in ("\n", "\r\n") else fmt.line)
    if fmt.skip:
        places = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        lines = places.mapInArrow(_without_first(fmt.skip), "value string")
    lines = lines.where("value <> ''")
    value = F.regexp_replace("value", "^﻿", "")
    fits = F.lit(True)
    if fmt.starter:
        fits = value.startswith(fmt.starter)
        value = value.substr(F.lit(len(fmt.starter) + 1), F.char_length(value))
    parsed = F.from_csv(value, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready), {k: v for k, v in options.items() if k not in ("encoding", "columnPruning")})
    rows = lines.select(parsed.alias("r"), fits.alias("fits"), F.col("value"))
    return rows.select(*(F.when(F.col("fits"), F.col(f"r.{f.name}")).alias(f.name) for f in schema), F.when(F.col("fits"), F.col("r._error")).otherwise(F.col("value")).alias("_error"))


def _without_first(n: int):
    """Leaves the first n lines out of each file: a task meets a file's lines in order, and those of its beginning in one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            keep = []
            for file, block in zip(batch["file"].to_pylist(), batch["block"].to_pylist()):
                seen[file] = seen.get(file, 0) + 1
                keep.append(block > 0 or seen[file] > n)
            yield pa.RecordBatch.from_arrays([batch["value"].filter(pa.array(keep, pa.bool_()))], names=["value"])

    return run


def split_errors(loaded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): what was read and the lines that weren't."""
    return loaded.where("_error is null").drop("_error"), loaded.where("_error is not null").select("_error")


def export(df: DataFrame, path: str, fmt: TextFormat = TextFormat(line="\n")) -> None:
    """INTO OUTFILE: text files; binary columns as hexadecimal digits, nulls as the null text."""
    plain = df.select(*(F.hex(f.name).alias(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f.name) for f in df.schema))
    plain.write.mode("overwrite").options(sep=fmt.delimiter, quote=fmt.enclosure, escape=fmt.escape, nullValue=fmt.null, lineSep=fmt.line, encoding=fmt.charset, emptyValue=fmt.enclosure * 2).csv(path)


def dump_value(df: DataFrame, path: str) -> None:
    """INTO DUMPFILE: the one value of a result, as it is; anything but one row of one column is refused."""
    rows = df.limit(2).collect()
    if len(rows) != 1 or len(df.columns) != 1:
        raise ValueError("a dump takes one row of one column")
    v = rows[0][0]
    with open(path, "wb") as f:
        f.write(bytes(v) if isinstance(v, bytearray | bytes) else str(v).encode())


#: Codes of the binary row format: type letter, struct letter, width.
BINARY = {"int": ("i", 4), "bigint": ("q", 8), "double": ("d", 8)}
ARROW = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}


def write_binary(df: DataFrame, path: str) -> None:
    """Rows of int, bigint and double columns in files of fixed-width little-endian records, each led by a byte per column that is 1 for null."""
    import struct

    kinds = [f.dataType.simpleString() for f in df.schema]
    form = "<" + "?" * len(kinds) + "".join(BINARY[k][0] for k in kinds)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            rows = [struct.pack(form, *(v is None for v in r), *(0 if v is None else v for v in r)) for r in zip(*columns)]
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(rows).hex()])], names=["value"])

    df.mapInArrow(pack, "value string").write.mode("overwrite").text(path)


def read_binary(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows that :func:`write_binary` wrote; a chunk of records that is cut short raises."""
    import struct

    kinds = [f.dataType.simpleString() for f in schema]
    form = "<" + "?" * len(kinds) + "".join(BINARY[k][0] for k in kinds)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(kinds)
        for batch in batches:
            for text in batch["value"].to_pylist():
                rows = list(struct.iter_unpack(form, bytes.fromhex(text)))
                columns = [pa.array([None if r[i] else r[n + i] for r in rows], ARROW[k]) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = schema.names
    return spark.read.text(path).mapInArrow(unpack, schema)
