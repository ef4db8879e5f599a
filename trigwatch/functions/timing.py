"""Timestamp parsing, formatting and window arithmetic on wall-clock time.

All functions take and return ``Column``. Event time is kept as TIMESTAMP_NTZ: windows
are cut by the local clock, so no zone conversion may move an event across a boundary.
"""

from __future__ import annotations

from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text formats of the alert source and of stored documents.
SIEM_FORMAT = "MMM d, yyyy, h:mm:ss a"
PLAIN_FORMAT = "yyyy-MM-dd HH:mm:ss"
ISO_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXX",
    "yyyy-MM-dd'T'HH:mm:ssXX",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
)
WINDOW_ID_FORMAT = "yyyy-MM-dd_HH-mm-ss"


def parse_siem_ts(text: Column) -> Column:
    """``Jul 29, 2025, 5:34:47 PM`` to wall-clock time; unparsable text gives null."""
    return F.try_to_timestamp(F.trim(text), F.lit(SIEM_FORMAT)).cast("timestamp_ntz")


def parse_ts_any(text: Column, formats=(SIEM_FORMAT, PLAIN_FORMAT), offset_seconds: int = 0) -> Column:
    """First format that parses, shifted by a fixed ingest offset."""
    trimmed = F.trim(text)
    tries = [F.try_to_timestamp(trimmed, F.lit(f)).cast("timestamp_ntz") for f in formats]
    parsed = F.coalesce(*tries)
    if offset_seconds:
        parsed = parsed + F.make_dt_interval(secs=F.lit(offset_seconds))
    return parsed


def format_siem_ts(ts: Column) -> Column:
    return F.date_format(ts, SIEM_FORMAT)


def is_valid_ts(text: Column) -> Column:
    return parse_siem_ts(text).isNotNull()


def _known_zone(zone: str) -> str:
    try:
        ZoneInfo(zone)
        return zone
    except Exception:
        return "UTC"


def to_zone(ts: Column, target: str, source: str = "UTC") -> Column:
    """Wall-clock time of ``ts`` in another zone; an unknown zone name means UTC."""
    return F.convert_timezone(F.lit(_known_zone(source)), F.lit(_known_zone(target)), ts.cast("timestamp_ntz"))


def format_utc(ts: Column, source: str = "UTC") -> Column:
    return F.concat(F.date_format(to_zone(ts, "UTC", source), PLAIN_FORMAT), F.lit(" UTC"))


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def _floor(minutes: Column, size: int) -> Column:
    return minutes - minutes % size


def window_number(ts: Column, size: int) -> Column:
    return (_floor(minute_of_day(ts), size) / size).cast("int")


def _midnight(ts: Column) -> Column:
    return F.to_date(ts).cast("timestamp_ntz")


def window_start(ts: Column, size: int) -> Column:
    """Day-anchored floor: windows restart at midnight even if size does not divide a day."""
    return _midnight(ts) + F.make_dt_interval(mins=_floor(minute_of_day(ts), size))


def window_end(ts: Column, size: int) -> Column:
    return _midnight(ts) + F.make_dt_interval(mins=_floor(minute_of_day(ts), size) + size)


def window_id(ts: Column, size: int) -> Column:
    return F.concat(
        F.date_format(window_start(ts, size), WINDOW_ID_FORMAT),
        F.lit("_W"),
        window_number(ts, size).cast("string"),
    )


def start_of_id(window_id: Column) -> Column:
    """Start time that a window id spells out."""
    return F.try_to_timestamp(F.substring(window_id, 1, 19), F.lit(WINDOW_ID_FORMAT)).cast("timestamp_ntz")


def window_start_hour(ts: Column, size: int) -> Column:
    """Hour-anchored floor used at ingest; equals ``window_start`` only if size divides 60."""
    return _midnight(ts) + F.make_dt_interval(hours=F.hour(ts), mins=_floor(F.minute(ts), size))


def window_end_hour(ts: Column, size: int) -> Column:
    return window_start_hour(ts, size) + F.make_dt_interval(mins=F.lit(size))


def window_id_hour(ts: Column, size: int) -> Column:
    return F.date_format(window_start_hour(ts, size), WINDOW_ID_FORMAT)


def snap_window(ts: Column, size: int, tolerance_seconds: int = 5) -> Column:
    """Snap to the boundary within the tolerance, else to the nearest one.

    The last boundary of a day is midnight, also when size does not divide a day.
    """
    start = _floor(minute_of_day(ts), size)
    following = F.least(start + size, F.lit(1440))
    exact = (F.hour(ts) * 3600 + F.minute(ts) * 60) + F.extract(F.lit("SECOND"), ts).cast("double")
    whole = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    late_half = (whole % (size * 60)) * 2 >= size * 60
    chosen = (
        F.when(exact - start * 60 <= tolerance_seconds, start)
        .when(following * 60 - exact <= tolerance_seconds, following)
        .when(late_half, following)
        .otherwise(start)
    )
    return _midnight(ts) + F.make_dt_interval(mins=chosen)
