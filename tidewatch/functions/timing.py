"""Window, bucket and day arithmetic on epoch seconds, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
SLOTS = 7


def window_start(ts: Column, size: int) -> Column:
    """Start of the tumbling window of ts; floors negative times too."""
    return ts - F.pmod(ts, F.lit(size))


def time_bucket(ws: Column) -> Column:
    """0..47: the UTC hour, plus 24 on Saturday and Sunday."""
    hour = F.floor(F.pmod(ws, F.lit(DAY)) / 3600)
    weekday = F.pmod(F.floor(ws / DAY) + 3, F.lit(7))  # 0: Monday; the epoch was a Thursday
    return (hour + F.when(weekday >= 5, 24).otherwise(0)).cast("int")


def day_epoch(ws: Column) -> Column:
    return F.floor(ws / DAY).cast("long")


def day_slot(day: Column, slots: int = SLOTS) -> Column:
    return F.pmod(day, F.lit(slots)).cast("int")


def utc_day(ws: Column) -> Column:
    """YYYYMMDD of epoch seconds."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ws / DAY).cast("int")), "yyyyMMdd")
