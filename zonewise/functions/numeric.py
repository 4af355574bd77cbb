"""Null, cast and rounding rules shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(value: Column, digits: int = 0) -> Column:
    """Round half to even after scaling; Spark's own ``round`` goes half up."""
    if digits == 0:
        return F.rint(value)
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def nan_to_null(value: Column) -> Column:
    """Spark orders NaN above every number, so a missing value must be NULL before any comparison."""
    return F.when(~F.isnan(value), value)


def to_number(value: Column) -> Column:
    """Double, or NULL where the text is no number."""
    return nan_to_null(value.try_cast("double"))
