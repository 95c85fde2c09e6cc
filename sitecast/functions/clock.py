"""Grid slots and calendar cycles. Timestamps carry no zone and are read as they stand."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitecast.schema import SLOT_MICROS


def micros(ts: Column) -> Column:
    """Microseconds since 1970 on the wall clock, independent of the session time zone."""
    days = F.date_diff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    minutes = days * 1440 + F.hour(ts) * 60 + F.minute(ts)
    within = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return minutes * 60_000_000 + within


def slot_floor(us: Column, width: int = SLOT_MICROS) -> Column:
    """Number of the slot a moment falls into."""
    return F.call_function("div", us - F.pmod(us, F.lit(width)), F.lit(width))


def slot_ceil(us: Column, width: int = SLOT_MICROS) -> Column:
    """First slot whose start is not before the moment."""
    return slot_floor(us + (width - 1), width)


def slot_start(slot: Column, width: int = SLOT_MICROS) -> Column:
    """Start of a slot as a zone-less timestamp."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", slot * width, epoch)


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def day_sin(ts: Column) -> Column:
    seconds = minute_of_day(ts) * 60 + F.second(ts)
    return F.sin(seconds * (2 * math.pi) / 86400)


def year_sin(ts: Column) -> Column:
    return F.sin(F.dayofyear(ts) * (2 * math.pi) / 365.25)
