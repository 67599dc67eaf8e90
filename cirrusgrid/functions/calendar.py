"""Calendars with months of thirty days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode_360day(hours: Column) -> Column:
    """struct(y, m, d) of hours since 1970 counted in years of 360 days."""
    y = F.floor(hours / 8640)
    rest = hours - y * 8640
    m = F.ceil(rest / 720)
    d = F.ceil((rest - (m - 1) * 720) / 24)
    return F.named_struct(F.lit("y"), (y + 1970).cast("int"), F.lit("m"), m.cast("int"), F.lit("d"), d.cast("int"))


def repair_360day(ymd: Column) -> Column:
    """A real date for a struct(y, m, d) of a 360-day year; dates that can't be are null.

    March moves on by a day and February back by one; what falls before February is 31 January, and 29 February is 1 March.
    """
    y, m, d = ymd["y"], ymd["m"], ymd["d"]
    d = F.when(m == 3, d + 1).when(m == 2, d - 1).otherwise(d)
    early, leap = (m == 2) & (d == 0), (m == 2) & (d == 29)
    month = F.when(early, 1).when(leap, 3).otherwise(m)
    day = F.when(early, 31).when(leap, 1).otherwise(d)
    # A cast takes years of five digits and more, which patterns don't.
    return F.format_string("%04d-%02d-%02d", y, month, day).try_cast("date")
