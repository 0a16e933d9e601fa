"""Number semantics of loosely typed records: parsing, half-up cents, printing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def loose_number(value: Column) -> Column:
    """A JSON scalar's text as a double: empty is 0, anything that isn't a number is NaN, null stays null."""
    return F.when(F.trim(value) == "", F.lit(0.0)).when(value == "true", F.lit(1.0)).when(value == "false", F.lit(0.0)).when(value.rlike(NUMBER), F.trim(value).try_cast("double")).when(value.isNotNull(), F.lit(float("nan")))


def cents(value: Column) -> Column:
    """Rounded to cents, halves upwards (also below zero); NaN stays NaN."""
    return F.when(F.isnan(value), value).otherwise(F.floor(value * 100 + 0.5).cast("double") / 100)


def printed(value: Column) -> Column:
    """Shortest plain form: 300 rather than 300.0."""
    plain = F.regexp_replace(value.cast("decimal(28,6)").cast("string"), r"\.?0+$", "")
    return F.when(F.isnan(value), F.lit("NaN")).otherwise(F.when(F.abs(value) < 0.0000005, F.lit("0")).otherwise(plain))


def differs(a: Column, b: Column, tolerance: float) -> Column:
    """|a - b| > tolerance, and false where either isn't a number."""
    d = F.abs(a - b)
    return F.coalesce(~F.isnan(d) & (d > tolerance), F.lit(False))
