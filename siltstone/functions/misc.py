"""Geometry in well-known text, and other functions that need Python batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

NUMBER = r"\s*(-?\d+(?:\.\d+)?)\s+(-?\d+(?:\.\d+)?)\s*"


def point_x(wkt: Column) -> Column:
    """X of POINT(x y); null for other shapes."""
    return F.regexp_extract(wkt, rf"^POINT\({NUMBER}\)$", 1).try_cast("double")


def point_y(wkt: Column) -> Column:
    return F.regexp_extract(wkt, rf"^POINT\({NUMBER}\)$", 2).try_cast("double")


def geometry(wkt: Column) -> Column:
    """GeomFromText and AsText in one: the text in a plain form, or null where it is no point, line or polygon."""
    form = r"^\s*(POINT|LINESTRING|POLYGON)\s*\("
    plain = F.regexp_replace(F.regexp_replace(F.trim(F.upper(wkt)), r"\s*([(),])\s*", "$1"), r"\s+", " ")
    return F.when(F.upper(wkt).rlike(form), plain)


def _box(wkt: str | None) -> tuple[float, float, float, float] | None:
    found = [(float(x), float(y)) for x, y in re.findall(NUMBER, wkt or "")]
    if not found:
        return None
    xs, ys = zip(*found)
    return min(xs), min(ys), max(xs), max(ys)


@F.pandas_udf(BooleanType())
def intersects(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether the bounding boxes meet, as the reference's MBR predicates; null for what has no coordinates."""

    def one(x, y):
        p, q = _box(x), _box(y)
        return None if p is None or q is None else p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3]

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=object)
