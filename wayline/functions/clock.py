"""Clock arithmetic that does not depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wall_clock(moment: Column) -> Column:
    """A timestamp whose UTC reading is what the session's clock shows.

    Works for timestamps with and without a time zone; week and day arithmetic
    on the result follows the session's days.
    """
    return F.from_utc_timestamp(moment.cast("timestamp"), F.current_timezone())


def wall_micros(moment: Column) -> Column:
    return F.unix_micros(wall_clock(moment))


def wall_date(clock: Column) -> Column:
    """The day of a :func:`wall_clock` timestamp."""
    days = F.floor(F.unix_seconds(clock) / 86_400).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days)
