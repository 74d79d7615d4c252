"""UTC timestamps as text and durations, as column expressions. The clock is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The accepted form of a timestamp and of a duration; a year is 365 days, a month 30.
STAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?Z$"
DURATION = r"^P(?=.)(?:([0-9]+)Y)?(?:([0-9]+)M)?(?:([0-9]+)D)?(?:T(?=.)(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+(?:\.[0-9]+)?)S)?)?$"
UNIT_MS = (365 * 86_400_000, 30 * 86_400_000, 86_400_000, 3_600_000, 60_000, 1_000)


def parse_stamp(text: Column) -> Column:
    """A timestamp of millisecond precision; null unless the text is UTC with its ``Z``."""
    whole = F.try_to_timestamp(F.when(text.rlike(STAMP), F.concat(F.substring(text, 1, 19), F.lit("Z"))), F.lit("yyyy-MM-dd'T'HH:mm:ssX"))
    millis = F.rpad(F.substring(F.regexp_extract(text, r"\.([0-9]+)Z$", 1), 1, 3), 3, "0").cast("long")
    return F.timestamp_millis(F.unix_millis(whole) + F.coalesce(millis, F.lit(0)))


def epoch_millis(text: Column) -> Column:
    return F.unix_millis(parse_stamp(text))


def format_stamp(stamp: Column) -> Column:
    """The text of a timestamp; the fraction appears only where it is above zero."""
    fraction = F.when(F.pmod(F.unix_millis(stamp), F.lit(1000)) > 0, F.date_format(stamp, ".SSS")).otherwise("")
    return F.concat(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))


def compare_stamps(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    return F.signum(epoch_millis(a) - epoch_millis(b)).cast("int")


def days_of(duration: Column) -> Column:
    """The number of days of a ``PnD`` duration; null for any other."""
    return F.regexp_extract(duration, r"^P([0-9]+)D$", 1).try_cast("int")


def add_days(stamp: Column, duration: Column) -> Column:
    """A timestamp moved by a ``PnD`` duration, by the calendar."""
    return stamp + F.make_dt_interval(days_of(duration))


def add_duration(text: Column, duration: Column) -> Column:
    return format_stamp(add_days(parse_stamp(text), duration))


def duration_millis(duration: Column) -> Column:
    """The length of a full duration in milliseconds; null where it is malformed or empty."""
    total = F.lit(0).cast("double")
    for k, unit in enumerate(UNIT_MS):
        total = total + F.coalesce(F.regexp_extract(duration, DURATION, k + 1).try_cast("double"), F.lit(0.0)) * unit
    return F.when(duration.rlike(DURATION), F.floor(total).cast("long"))


def is_leap_year(year: Column) -> Column:
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


def days_in_month(year: Column, month: Column) -> Column:
    return F.day(F.last_day(F.make_date(year, month, F.lit(1))))


def custody_stale(created: Column, policy: Column, at: Column) -> Column:
    """Whether a claim of possession is older than its policy allows; without policy it never is.

    ``created`` and ``at`` are timestamps. At the very end of the period the claim still holds.
    """
    return F.when(policy.isNull(), F.lit(False)).otherwise(F.unix_millis(at) > F.unix_millis(created) + duration_millis(policy))


def document_stale(created: Column, most_millis: Column, at: Column) -> Column:
    """Whether a key document is older than ``most_millis``; zero switches the test off."""
    return F.coalesce((most_millis > 0) & (F.unix_millis(at) - F.unix_millis(created) > most_millis), F.lit(False))
