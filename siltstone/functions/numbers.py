"""Arithmetic and bit functions with the reference's semantics; a null argument gives null unless said otherwise."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits that decimal division adds to the scale of its left operand.
DIVISION_DIGITS = 4
UNSIGNED = "decimal(20,0)"
TWO_64 = 18446744073709551616


def divide(a: Column, b: Column, scale: int = 0, digits: int = DIVISION_DIGITS) -> Column:
    """a / b as a decimal with ``scale + digits`` places; division by zero gives null."""
    places = scale + digits
    quotient = F.try_divide(a.cast(f"decimal(19,{scale})"), b.cast(f"decimal(19,{scale})"))
    return F.round(quotient, places).cast(f"decimal(38,{places})")


def int_divide(a: Column, b: Column) -> Column:
    """a DIV b, toward zero; by zero null."""
    return F.when(b != 0, F.try_divide(a - F.try_mod(a, b), b).cast("bigint"))


def modulo(a: Column, b: Column) -> Column:
    """a MOD b with the sign of a; by zero null."""
    return F.try_mod(a, b)


def unsigned(c: Column) -> Column:
    """A 64-bit pattern read without sign."""
    return F.when(c < 0, c.cast(UNSIGNED) + F.lit(Decimal(TWO_64)).cast("decimal(21,0)")).otherwise(c.cast("decimal(21,0)")).cast(UNSIGNED)


def shift_left(c: Column, n: Column) -> Column:
    """c << n over 64 bits, without sign; from 64 bits on, or below 0, it is 0."""
    return unsigned(F.when((n >= 64) | (n < 0), F.lit(0).cast("bigint")).otherwise(F.call_function("shiftleft", c.cast("bigint"), n.cast("int"))))


def shift_right(c: Column, n: Column) -> Column:
    """c >> n over 64 bits, without sign; from 64 bits on, or below 0, it is 0."""
    return unsigned(F.when((n >= 64) | (n < 0), F.lit(0).cast("bigint")).otherwise(F.call_function("shiftrightunsigned", c.cast("bigint"), n.cast("int"))))


def bit_or(a: Column, b: Column) -> Column:
    return unsigned(a.cast("bigint").bitwiseOR(b.cast("bigint")))


def bit_and(a: Column, b: Column) -> Column:
    return unsigned(a.cast("bigint").bitwiseAND(b.cast("bigint")))


def bit_xor(a: Column, b: Column) -> Column:
    return unsigned(a.cast("bigint").bitwiseXOR(b.cast("bigint")))


def bit_not(a: Column) -> Column:
    return unsigned(F.bitwise_not(a.cast("bigint")))


def interval_index(n: Column, *bounds: Column) -> Column:
    """INTERVAL(n, b1, b2, …): how many of the ascending bounds n has reached; -1 where n is null."""
    reached = sum((F.when(n >= b, 1).otherwise(0) for b in bounds[1:]), F.when(n >= bounds[0], 1).otherwise(0))
    return F.when(n.isNull(), -1).otherwise(reached)


#: Limits of the whole-number types.
LIMITS = {"tinyint": (-128, 127), "smallint": (-32768, 32767), "mediumint": (-8388608, 8388607), "int": (-2147483648, 2147483647)}


def store(c: Column, kind: str) -> Column:
    """A number as a column of ``kind`` holds it: rounded half away from zero, then clamped to the type's limits."""
    low, high = LIMITS[kind]
    held = F.least(F.greatest(F.round(c.cast("decimal(38,9)"), 0), F.lit(low)), F.lit(high))
    return F.when(c.isNotNull(), held).cast({"mediumint": "int"}.get(kind, kind))


def truncate(c: Column, places: int) -> Column:
    """c cut, not rounded, to ``places``."""
    factor = F.lit(10.0**places)
    return F.when(c >= 0, F.floor(c * factor)).otherwise(F.ceil(c * factor)) / factor
