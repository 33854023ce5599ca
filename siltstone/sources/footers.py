"""Profiles of Parquet tables from their footers and dictionaries.

Nulls and extrema come from the footer wherever its statistics are exact; a chunk is scanned
only where they are missing, inexact or impossible. Distinct values come from the dictionary page of a
chunk whose data is all coded by it, and so does the answer that no value violates a pattern; only
other chunks, and those in which violations have to be counted, are scanned.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.shared import materialize
from siltstone.sources import pages

SHAPE = (
    "path string, row_group int, column_name string, kind string, family string, rows bigint, nulls bigint, low string, high string, low_d decimal(38,0), high_d decimal(38,0), "
    "low_n double, high_n double, from_footer boolean, violations bigint, hashes array<bigint>, scanned boolean"
)
#: Row groups whose footers alone a task reads at a time.
FOOTERS = 64


@dataclass
class Extremum:
    """An extremum as a text and in the form that it is ordered by: a whole number, a double, or neither (then the text)."""

    text: str
    whole: Decimal | None = None
    real: float | None = None


def family(t: pa.DataType) -> str:
    """Types whose extrema can be compared with each other: whole numbers of any width; else the type itself."""
    return "integer" if pa.types.is_integer(t) else str(t)


def _steps(t: pa.DataType) -> int | None:
    """Microseconds, or nanoseconds if negative, in a unit of a temporal type."""
    if pa.types.is_date32(t):
        return 86_400_000_000
    if pa.types.is_timestamp(t) or pa.types.is_time(t):
        return {"s": 1_000_000, "ms": 1000, "us": 1, "ns": -1000}[t.unit]
    return None


def extremum(v, t: pa.DataType) -> Extremum | None:
    """The extremum of a value, none of NaN: dates and times as whole numbers of their unit since 1970 or midnight, decimals as unscaled ones."""
    if v is None or v != v:
        return None
    steps = _steps(t)
    if steps is not None:
        micros = v * steps if steps > 0 else v // -steps
        if pa.types.is_time(t):
            text = (datetime.datetime.min + datetime.timedelta(microseconds=micros)).time().isoformat("microseconds")
        else:
            try:
                moment = datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=micros)
                text = moment.date().isoformat() if pa.types.is_date(t) else moment.isoformat(" ", "microseconds")
            except OverflowError:
                text = str(v)
        return Extremum(text, Decimal(v))
    if isinstance(v, Decimal):
        return Extremum(str(v), v.scaleb(t.scale).to_integral_value())
    if isinstance(v, bool | int):
        return Extremum(str(v), Decimal(int(v)))
    if isinstance(v, float):
        return Extremum(str(v), None, v)
    if isinstance(v, bytes):
        return Extremum(v.hex() if pa.types.is_binary(t) or pa.types.is_fixed_size_binary(t) else v.decode("utf-8", "replace"))
    return Extremum(str(v))


def exact_statistics(chunk, t: pa.DataType, marked: bool) -> tuple[int, Extremum | None, Extremum | None] | None:
    """(nulls, least, greatest) of a column chunk's footer, or None where they aren't known to be exact.

    Not exact: no statistics or null count, counts that don't add up, least above greatest, extrema of byte
    arrays that aren't ``marked`` as exact (they may be truncated; decimals can't be), floating-point
    columns (their extrema leave NaN out).
    """
    s = chunk.statistics
    if s is None or not s.has_null_count or not 0 <= s.null_count <= chunk.num_values:
        return None
    if s.null_count == chunk.num_values:
        return s.null_count, None, None
    if not s.has_min_max or chunk.physical_type in ("FLOAT", "DOUBLE", "INT96"):
        return None
    if not marked and not pa.types.is_decimal(t) and chunk.physical_type in ("BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY"):
        return None
    try:
        low, high = (s.min_raw, s.max_raw) if _steps(t) is not None else (s.min, s.max)
    except (OverflowError, ValueError, UnicodeDecodeError):
        return None
    return (s.null_count, extremum(low, t), extremum(high, t)) if low <= high else None


def _seen(keys: pa.Array) -> tuple[Extremum | None, Extremum | None]:
    """Least and greatest of values that were read."""
    import pyarrow.compute as pc

    t = keys.type
    if pa.types.is_date32(t) or pa.types.is_time32(t):
        keys = keys.cast(pa.int32())
    elif _steps(t) is not None:
        keys = keys.cast(pa.int64())
    ends = pc.min_max(keys)
    return extremum(ends["min"].as_py(), t), extremum(ends["max"].as_py(), t)


def _profile_chunk(file, g: int, name: str, t: pa.DataType, known: tuple | None, words, pattern: str | None, distinct: bool) -> tuple:
    """(nulls, low, high, violations, hashes, scanned): from footer and dictionary as far as they tell, else from the data."""
    import pyarrow.compute as pc

    bad = found = None
    if words is not None:
        found = pages.hashes(words) if distinct else None
        if pattern is not None and isinstance(words, list) and pc.all(pc.match_substring_regex(pa.array(words, pa.binary()).cast(pa.string()), pattern), min_count=0).as_py():
            bad = 0
    scan = known is None or (distinct and found is None) or (pattern is not None and bad is None)
    exact = known
    if scan:
        counted = pc.value_counts(file.read_row_group(g, columns=[name])[name].combine_chunks())
        keys, counts = counted.field("values"), counted.field("counts").to_numpy()
        if pa.types.is_dictionary(keys.type):
            keys = keys.dictionary_decode()
        there = keys.is_valid().to_numpy(zero_copy_only=False)
        if known is None:
            exact = int(counts[~there].sum()), *_seen(keys)
        if pattern is not None and pa.types.is_string(keys.type):
            fits = pc.match_substring_regex(keys, pattern).to_numpy(zero_copy_only=False)
            bad = int(counts[there & (fits == False)].sum())  # noqa: E712
        if distinct and found is None:
            found = pages.hashes(pages.physical(keys.drop_null()))
    return *exact, bad, found, scan


def _flat(schema: pa.Schema, columns: frozenset[str] | None) -> list[str]:
    return [f.name for f in schema if not pa.types.is_nested(f.type) and (columns is None or f.name in columns)]


def _row_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq
    from pyarrow import fs

    for batch in batches:
        for uri in batch["path"].to_pylist():
            system, path = fs.FileSystem.from_uri(uri)
            with system.open_input_file(path) as handle:
                yield pa.RecordBatch.from_pydict({"path": [uri], "n": pa.array([pq.read_metadata(handle).num_row_groups], pa.int32())})


def _chunks(patterns: Mapping[str, str], distinct: bool, columns: frozenset[str] | None):
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            for uri, first, after in zip(*(batch[c].to_pylist() for c in ("path", "first", "after"))):
                system, path = fs.FileSystem.from_uri(uri)
                with system.open_input_file(path) as handle:
                    footer = pq.ParquetFile(handle)
                    flat = _flat(footer.schema_arrow, columns)
                    texts = [f.name for f in footer.schema_arrow if pa.types.is_string(f.type) or pa.types.is_binary(f.type)]
                    file = pq.ParquetFile(handle, metadata=footer.metadata, read_dictionary=texts)
                    place = {footer.metadata.schema.column(i).path: i for i in range(footer.metadata.num_columns)}
                    coded = pages.chunks(handle)
                    for g in range(first, after):
                        group, out = footer.metadata.row_group(g), []
                        for name in flat:
                            t = footer.schema_arrow.field(name).type
                            known = exact_statistics(group.column(place[name]), t, name in coded[g] and coded[g][name].exact)
                            words = pages.dictionary(handle, coded[g][name]) if (distinct or name in patterns) and name in coded[g] else None
                            nulls, low, high, bad, found, scan = _profile_chunk(file, g, name, t, known, words, patterns.get(name), distinct)
                            ends = [getattr(e, part) if e else None for part in ("text", "whole", "real") for e in (low, high)]
                            out.append((uri, g, name, str(t), family(t), group.num_rows, nulls, *ends, known is not None, bad, found, scan))
                        if out:
                            yield _batch(out)

    return profile


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of SHAPE as a batch; hashes are joined as arrays, not value by value."""
    schema = _arrow()
    columns = []
    for field, values in zip(schema, zip(*rows)):
        if field.name == "hashes":
            offsets = np.cumsum([0, *(0 if v is None else len(v) for v in values)], dtype=np.int32)
            flat = np.concatenate([np.zeros(0, np.int64), *(v for v in values if v is not None)])
            columns.append(pa.ListArray.from_arrays(offsets, pa.array(flat), mask=pa.array([v is None for v in values])))
        else:
            columns.append(pa.array(values, field.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _arrow() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()), "decimal(38,0)": pa.decimal128(38, 0)}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in SHAPE.split(", "))])


def chunk_statistics(spark: SparkSession, path: str | Sequence[str], patterns: Mapping[str, str] | None = None, distinct: bool = True, columns: Sequence[str] | None = None) -> DataFrame:
    """A row per row group and flat column (of ``columns`` if given) of the table at ``path`` (or several).

    A task takes row groups one at a time, or FOOTERS of a file together where footers are all that is asked for; a
    large file is spread over tasks by its row groups. ``patterns`` gives RE2 patterns of string
    columns by name: violations counts the values, nulls apart, that don't contain a match.
    from_footer tells whether nulls and extrema needed no scan, scanned whether anything did.
    Nested columns are left out; files without rows give none.
    """
    cores = spark.sparkContext.defaultParallelism
    files = spark.read.parquet(*([path] if isinstance(path, str) else path)).inputFiles()
    listed = spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, min(len(files), 4 * cores)))
    groups = listed.mapInArrow(_row_groups, "path string, n int").collect()  # a row per file, as the list itself
    step = 1 if distinct or patterns else FOOTERS
    units = [(r["path"], a, min(r["n"], a + step)) for r in groups for a in range(0, r["n"], step)]
    spread = spark.createDataFrame(units, "path string, first int, after int").repartition(max(1, min(len(units), 4 * cores)))
    return spread.mapInArrow(_chunks(dict(patterns or {}), distinct, None if columns is None else frozenset(columns)), SHAPE)


def _end(pick, side: str) -> Column:
    """The text of the extremum over chunks, in the order of the column's kind."""
    own = F.when(F.col(side).isNotNull(), F.struct(f"{side}_d", f"{side}_n", side))
    return F.when(F.min("family") == F.max("family"), pick(own)[side]).alias(side)


def column_profiles(chunks: DataFrame, approximate: bool = False) -> DataFrame:
    """What :func:`profile_columns` gives, of the rows of :func:`chunk_statistics`."""
    base = chunks.groupBy("column_name").agg(
        F.max("kind").alias("kind"),
        F.sum("rows").alias("rows"),
        F.sum("nulls").alias("nulls"),
        _end(F.min, "low"),
        _end(F.max, "high"),
        F.sum("violations").alias("violations"),
        F.count(F.lit(1)).alias("chunks"),
        F.count_if("from_footer").alias("from_footer"),
        F.count_if("scanned").alias("scanned"),
    )
    hashed = chunks.select("column_name", F.explode("hashes").alias("h"))
    if approximate:
        counted = hashed.groupBy("column_name").agg(F.approx_count_distinct("h", 0.01).alias("n_distinct"))
    else:
        counted = hashed.distinct().groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))
    return base.join(counted, "column_name", "left").select(
        "column_name", "kind", "rows", "nulls", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "low", "high", "violations", "chunks", "from_footer", "scanned"
    )


def profile_columns(spark: SparkSession, path: str, patterns: Mapping[str, str] | None = None, approximate: bool = False) -> DataFrame:
    """(column_name, kind, rows, nulls, n_distinct, low, high, violations, chunks, from_footer, scanned) of each flat column.

    Distinct values are counted by 64-bit number, of texts a hash; nulls don't count. ``approximate`` counts
    them by sketches within 1 %, which are merged without moving the values. low and high are texts,
    compared as what they are: whole numbers of any size, decimals, dates and times exactly, floating
    point as doubles, the rest byte by byte; binary values show as hexadecimal digits, times to the microsecond. A column in
    which all is null has null extrema, as has one whose files differ in its type (whole numbers of
    several widths apart); a column without pattern has null violations.
    """
    chunks = chunk_statistics(spark, path, patterns)
    return column_profiles(materialize(chunks, "chunks"), approximate)  # both aggregations read it


def load_reports(spark: SparkSession, loads: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The chunks of several loads of one table, from footers, as the reports that :func:`siltstone.operators.quality.check_reports` takes.

    attr_id is the column's name, load_no the place in ``loads`` from 1, pack_no the chunk's number
    within its file. Only whole numbers have extrema, as in packs.
    """
    out = None
    for i, path in enumerate(loads, 1):
        part = chunk_statistics(spark, path, distinct=False, columns=columns)
        whole = F.col("family") == "integer"
        own = part.select(
            F.col("column_name").alias("attr_id"), F.lit(i).alias("load_no"), F.col("row_group").alias("pack_no"), F.col("path").alias("file"), F.when(whole, 10).otherwise(30).alias("pack_type"),
            F.col("rows").alias("no_obj"), F.col("nulls").alias("no_nulls"), F.when(whole, F.col("low_d")).cast("bigint").alias("min_n"), F.when(whole, F.col("high_d")).cast("bigint").alias("max_n"),
        )
        out = own if out is None else out.unionByName(own)
    return out
