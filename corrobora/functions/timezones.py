"""Wall-clock time to UTC with explicit rules for the two odd hours of the year."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .scalars import as_col


def wall_to_utc(wall: Column | str, zone: str, gap: str = "shift_forward", fold: str = "null") -> Column:
    """UTC instant (as a naive UTC timestamp) of a naive wall-clock time in ``zone``.

    gap  (spring forward, the wall time never existed):
         'shift_forward' -> first existing instant after the gap; 'offset' -> keep the minutes,
         shifted by the gap length (the engine's own rule).
    fold (fall back, the wall time exists twice): 'null' -> NULL; 'earlier' -> first of the two.
    """
    wall = as_col(wall).cast("timestamp_ntz")
    if zone == "UTC":
        return wall
    utc = F.to_utc_timestamp(wall.cast("timestamp"), zone)
    back = F.from_utc_timestamp(utc, zone)
    stamp = wall.cast("timestamp")
    result = utc
    if gap == "shift_forward":
        result = F.when(back != stamp, F.to_utc_timestamp(F.date_trunc("hour", back), zone)).otherwise(result)
    elif gap != "offset":
        raise ValueError(f"unknown gap policy {gap!r}")
    if fold == "null":
        again = F.from_utc_timestamp(utc + F.expr("INTERVAL 1 HOUR"), zone)
        result = F.when(again == stamp, F.lit(None).cast("timestamp")).otherwise(result)
    elif fold != "earlier":
        raise ValueError(f"unknown fold policy {fold!r}")
    return result.cast("timestamp_ntz")


def iso_utc(c: Column | str) -> Column:
    """ISO-8601 text with an explicit zero offset."""
    return F.concat(F.date_format(as_col(c), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def span_days(low: Column, high: Column) -> Column:
    """Length of a time span in days, fractions kept."""
    return (F.unix_micros(high.cast("timestamp")) - F.unix_micros(low.cast("timestamp"))) / F.lit(86400e6)


def weekday0(c: Column | str) -> Column:
    """Day of week with Monday = 0."""
    return F.weekday(as_col(c))
