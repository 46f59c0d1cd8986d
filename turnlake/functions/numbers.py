"""Column expressions on numbers: banding, exact half-even rounding, duration text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def band(value: Column, low: float, high: float) -> Column:
    """unknown for null, low below the range, high above it, normal inside and on the edges."""
    return (F.when(value.isNull(), "unknown").when(value < low, "low")
            .when(value > high, "high").otherwise("normal"))


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def round_even(value: Column, digits: int) -> Column:
    """Round half to even on the exact binary value, as Python's ``round`` does.

    ``round`` and ``bround`` look at the shortest decimal text instead, so 2.675 ties there
    although the stored number lies below the tie. Here the scaled value is rounded; only
    where scaling lands on a tie does its rounding error decide, which splitting the value
    at single precision gives exactly.
    """
    scale = F.lit(float(10 ** digits))
    scaled = value * scale
    head = value.cast("float").cast("double")
    error = (head * scale - scaled) + (value - head) * scale
    nearest = F.when((scaled - F.floor(scaled) != 0.5) | (error == 0), F.rint(scaled)).otherwise(
        F.floor(scaled) + F.when(error > 0, 1.0).otherwise(0.0))
    return nearest / scale


def whole_text(value: Column) -> Column:
    """Nearest whole number as text, half to even."""
    return round_even(value, 0).cast("bigint").cast("string")


def one_decimal_text(value: Column) -> Column:
    return F.format_string("%.1f", round_even(value, 1))


def percent_text(ratio: Column) -> Column:
    return F.concat(whole_text(ratio * 100.0), F.lit("%"))


def duration_text(seconds: Column) -> Column:
    """'N seconds' below a minute, 'Mm SSs' from there on."""
    minutes = F.floor(seconds / 60.0)
    rest = F.floor(seconds - minutes * 60.0)
    return F.when(seconds < 60, F.concat(whole_text(seconds), F.lit(" seconds"))).otherwise(
        F.format_string("%dm %02ds", minutes, rest))
