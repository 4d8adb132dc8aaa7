"""Times of daily jobs in a zone's wall clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000


def _ahead(micros: Column, zone: Column) -> Column:
    """What a zone's wall clock is ahead of UTC at a time, in microseconds."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(micros), zone)) - micros


def _at_wall_clock(wall: Column, zone: Column) -> Column:
    """The time of a wall clock's reading; one that summer time skips is read by the later offset."""
    return wall - _ahead(wall - _ahead(wall, zone), zone)


def next_daily(now: Column, hour: Column, minute: Column, zone: Column) -> Column:
    """The first time after ``now`` at which clocks in the zone show hour and minute.

    Both times are microseconds since 1970 in UTC; null if an argument is.
    """
    today = F.floor((now + _ahead(now, zone)) / DAY).cast("long") * DAY
    at = (hour * 3600 + minute * 60).cast("long") * 1_000_000
    due = _at_wall_clock(today + at, zone)
    return F.when(due > now, due).otherwise(_at_wall_clock(today + DAY + at, zone))
