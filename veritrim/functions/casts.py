"""Lenient casts: bad text becomes a default or NULL, never NaN and never a failed job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritrim.functions.text import strip

# Decimal and exponent notation with optional digit grouping by single underscores.
_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_PLAIN = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
_SHAPE = rf"^[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"


def _finite(c: Column) -> Column:
    """The number a text spells, or NULL; infinities and NaN count as bad text."""
    text = strip(c.cast("string"))
    number = F.replace(text, F.lit("_"), F.lit("")).try_cast("double")
    return F.when(text.rlike(_SHAPE) & (F.abs(number) < float("inf")), number)


def lenient_float(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(_finite(c), F.lit(float(default)))


def lenient_int(c: Column, default: int = 0) -> Column:
    """A bigint, truncated towards zero, by way of a double, so ``1.0`` and ``1.9`` both give 1."""
    return F.coalesce(_finite(c).try_cast("bigint"), F.lit(int(default)).cast("bigint"))


def numeric(c: Column) -> Column:
    """The finite number a text spells in decimal or exponent notation, without digit grouping; else NULL."""
    text = strip(c.cast("string"))
    number = text.try_cast("double")
    return F.when(text.rlike(_PLAIN) & (F.abs(number) < float("inf")), number)


def timestamp(c: Column) -> Column:
    """ISO text, with or without microseconds or zone, as a timestamp; NULL for bad text."""
    return F.try_to_timestamp(c)
