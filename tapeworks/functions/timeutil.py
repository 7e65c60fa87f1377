"""Session calendar and clock columns over UTC wall-clock timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EASTERN = "America/New_York"
#: Regular session, in seconds of the Eastern day.
OPEN, CLOSE = 34200, 57600


def eastern(ts: Column) -> Column:
    """Eastern wall clock of a UTC wall clock."""
    return F.from_utc_timestamp(ts.cast("timestamp"), EASTERN).cast("timestamp_ntz")


def second_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def in_session(ts: Column, variant: str = "eastern") -> Column:
    """Regular-session test: by Eastern clock, by fixed UTC hours, or by the clock as it is."""
    if variant == "eastern":
        s = second_of_day(eastern(ts))
        return (s >= OPEN) & (s < CLOSE)
    s = second_of_day(ts)
    if variant == "utc":
        return (s >= 14 * 3600 + 1800) & (s < 21 * 3600)
    if variant == "naive":
        return (s >= OPEN) & (s < CLOSE)
    raise ValueError(f"unknown session variant: {variant}")


def session_date(ts: Column) -> Column:
    """Before the open, the previous date."""
    e = eastern(ts)
    return F.when(second_of_day(e) < OPEN, F.date_sub(e.cast("date"), 1)).otherwise(e.cast("date"))


def segment(ts: Column) -> Column:
    """open, midday or close of the regular session; else null."""
    m = minute_of_day(eastern(ts))
    return F.when((m >= 570) & (m < 660), "open").when((m >= 660) & (m < 870), "midday").when((m >= 870) & (m < 960), "close")


def slot(ts: Column, minutes: int = 15) -> Column:
    """Index of the slot of the regular session."""
    return F.floor((minute_of_day(eastern(ts)) - 570) / minutes).cast("int")


def slot_label(index: Column, minutes: int = 15) -> Column:
    m = index * minutes + 570
    return F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), (m % 60).cast("int"))


def weekday(ts: Column) -> Column:
    """Monday 0 to Sunday 6."""
    return F.weekday(ts)


def seconds_to_open(ts: Column) -> Column:
    """Seconds until the next open on a weekday; 0 during the session."""
    e = eastern(ts)
    s, d = second_of_day(e), F.weekday(e)
    later = F.when((d < 5) & (s < OPEN), 0).when(d == 4, 3).when(d == 5, 2).otherwise(1)
    inside = (d < 5) & (s >= OPEN) & (s < CLOSE)
    return F.when(inside, 0).otherwise(later * 86400 + OPEN - s).cast("long")


def cyclic(ts: Column) -> tuple[Column, Column]:
    """Sine and cosine of the share of the day that is over."""
    angle = second_of_day(ts) / F.lit(86400.0) * F.lit(2 * 3.141592653589793)
    return F.sin(angle), F.cos(angle)
