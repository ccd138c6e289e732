"""Predicates, flag decoding, coordinates and rounding of points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classification codes.
GROUND, LOW_NOISE, HIGH_NOISE, OVERLAP = 2, 7, 18, 12


def valid(classification: str = "classification", withheld: str = "withheld") -> Column:
    """Neither withheld nor noise."""
    return ~F.col(withheld) & ~F.col(classification).isin(LOW_NOISE, HIGH_NOISE)


def ground() -> Column:
    return valid() & (F.col("classification") == GROUND)


def aerial() -> Column:
    """Every valid point that is not ground, water and unknown classes included."""
    return valid() & (F.col("classification") != GROUND)


def class_flags(byte: Column, extended: bool) -> dict[str, Column]:
    """Flags of a record: from the classification byte of formats below 6, or from the flag byte of 6 and up."""
    bit = lambda n: byte.bitwiseAND(1 << n) != 0
    first = 0 if extended else 5
    out = {"synthetic": bit(first), "key_point": bit(first + 1), "withheld": bit(first + 2)}
    if extended:
        out |= {"overlap": bit(3), "scan_direction": bit(6), "edge": bit(7)}
    else:
        out["overlap"] = byte.bitwiseAND(31) == OVERLAP
    return out


def coordinate(raw: Column, scale: float, offset: float) -> Column:
    return F.lit(offset) + raw * F.lit(scale)


def scan_angle(raw: Column, extended: bool = True) -> Column:
    """Degrees; formats of 6 and up count steps of 0.006."""
    return raw * F.lit(0.006) if extended else raw.cast("double")


def to_metres(value: Column, feet: bool) -> Column:
    return value * F.lit(0.3048 if feet else 1.0)


def pack_cell(x: Column, y: Column) -> Column:
    """Two 32-bit indices in one long."""
    return F.shiftleft(x.cast("long"), 32).bitwiseOR(y.cast("long").bitwiseAND(0xFFFFFFFF))


def unpack_cell(key: Column) -> tuple[Column, Column]:
    low = key.bitwiseAND(0xFFFFFFFF)
    return F.shiftright(key, 32).cast("int"), F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int")


def ratio(a: Column, b: Column) -> Column:
    """Quotient of doubles, null where the divisor is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))
