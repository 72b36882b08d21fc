"""Time expressions; local datetimes are `yyyy-MM-dd HH:mm:ss` in a named zone, whatever the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL = "yyyy-MM-dd HH:mm:ss"
LOCAL_SHAPE = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"


def local_datetime(c: Column) -> Column:
    """The datetime without zone; null if it is not exactly of the local form or does not exist."""
    return F.when(c.rlike(LOCAL_SHAPE), c).try_cast("timestamp_ntz")


def local_millis(c: Column, zone: str) -> Column:
    """Epoch milliseconds of a local datetime in the zone."""
    zoned = F.concat_ws(" ", c, F.lit(zone))
    return F.unix_millis(F.when(c.rlike(LOCAL_SHAPE), F.try_to_timestamp(zoned, F.lit(LOCAL + " VV"))))


def business_day(ms: Column, zone: str) -> Column:
    """Natural day in the zone of epoch milliseconds."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_add("MILLISECOND", ms, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))))


def local_text(ms: Column, zone: str) -> Column:
    """Epoch milliseconds as a local datetime in the zone."""
    naive = F.timestamp_add("MILLISECOND", ms, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), naive), LOCAL)


def week_name(day: Column) -> Column:
    """Calendar year and ISO week, unpadded; around New Year they can belong to different years."""
    return F.concat(F.year(day).cast("string"), F.lit("W"), F.weekofyear(day).cast("string"))


def next_boundary(ms: Column, every_ms: int) -> Column:
    """The first multiple of the interval after the time."""
    return (F.floor(ms / every_ms) + 1) * every_ms
