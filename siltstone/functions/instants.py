"""Instants as whole microseconds since 1970, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def epoch_micros(df: DataFrame, name: str) -> Column:
    """Microseconds of the timestamp column ``name``; one without zone counts as UTC. Null gives null."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        seconds = F.expr(f"cast(extract(SECOND FROM `{name}`) * 1000000 AS bigint)")
        day = F.unix_date(c.cast("date")).cast("bigint")
        return ((day * 24 + F.hour(c)) * 60 + F.minute(c)) * 60_000_000 + seconds
    return F.unix_micros(c.cast("timestamp"))


def epoch_seconds(df: DataFrame, name: str) -> Column:
    """As :func:`epoch_micros`, in seconds as a double."""
    return epoch_micros(df, name).cast("double") / F.lit(1e6)
