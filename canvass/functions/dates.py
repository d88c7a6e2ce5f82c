"""Dates, clock times and time zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_zone(wall_clock: Column, zone: str, source_zone: str = "UTC") -> Column:
    """Show a zone-less timestamp of ``source_zone`` as the wall clock of ``zone``."""
    return F.convert_timezone(F.lit(source_zone), F.lit(zone), wall_clock)


def epoch_to_zone(seconds: Column, zone: str) -> Column:
    """Epoch seconds as the wall clock of ``zone``, whatever the session's own zone is."""
    epoch = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    return to_zone(epoch + F.make_dt_interval(secs=seconds), zone)


def day(moment: Column) -> Column:
    return F.to_date(moment)


def clock(moment: Column) -> Column:
    """Time of day as ``HH:MM:SS`` text."""
    return F.date_format(moment, "HH:mm:ss")
