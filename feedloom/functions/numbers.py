"""Percentages, durations and ISO rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column, digits: int = 3) -> Column:
    """100·part/whole of two counts, rounded once, 0 for an empty whole.

    The ratio is formed from exact decimals, so the result does not depend on
    partitioning.
    """
    hundredfold = part.cast("decimal(20,0)") * F.lit(100).cast("decimal(3,0)")
    ratio = F.round((hundredfold / whole.cast("decimal(20,0)")).cast("decimal(38,12)"), digits)
    return F.when(whole > 0, ratio.cast("double")).otherwise(F.lit(0.0))


def seconds_between(start: Column, end: Column, digits: int = 3) -> Column:
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.round(micros / 1e6, digits)


def iso(c: Column) -> Column:
    """ISO-8601 text; the fraction appears only when there is one."""
    fraction = F.date_format(c, "SSSSSS")
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, F.when(fraction != "000000", F.concat(F.lit("."), fraction)).otherwise(""))
