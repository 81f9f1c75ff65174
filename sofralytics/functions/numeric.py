"""Rounding shared by every operator that publishes a rounded number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(value: Column, digits: int) -> Column:
    """Half-up rounding with a small nudge, so binary noise around a tie does not flip a digit.

    Different engines sum doubles in different orders; a result such as 2.4999999999 and
    2.5000000001 must publish the same value.  Ties can differ by one unit in the last place from
    half-even rounding.
    """
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5) + F.lit(1e-6)) / F.lit(scale)


def clamp(value: Column, low, high) -> Column:
    """Value limited to [low, high]; NULL stays NULL."""
    return F.when(value.isNull(), F.lit(None)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), value)))


def percent_half_up(part: Column, whole: Column) -> Column:
    """Integer percentage, halves rounded up; 0 when the whole is 0."""
    return F.when(whole > 0, F.floor(F.lit(100.0) * part / whole + F.lit(0.5)).cast("long")).otherwise(F.lit(0).cast("long"))
