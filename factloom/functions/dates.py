"""Dates, ages and windows of time. Every "now" is an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper ends, in days, and what a card of that age scores; older ones score the last.
RECENCY = ((2, 4), (4, 3), (8, 2), (15, 1), (30, 0))
STALE = -5
NET_WORTH_DAYS = 365
CLOCK_TRUST_SECONDS = 300
ADULT = 18


def days_between(ts: Column, as_of: Column) -> Column:
    return (F.unix_timestamp(as_of) - F.unix_timestamp(ts)) / 86400.0


def recency(ts: Column, as_of: Column) -> Column:
    """Score by age; 0 for no date."""
    out = F.when(ts.isNull(), F.lit(0))
    for under, points in RECENCY:
        out = out.when(days_between(ts, as_of) < under, F.lit(points))
    return out.otherwise(F.lit(STALE))


def age_class(ts: Column, as_of: Column, datable: Column, days: int = NET_WORTH_DAYS) -> Column:
    """current, stale, or undated where the source cannot date its figure."""
    return F.when(~datable | ts.isNull(), "undated").when(days_between(ts, as_of) > days, "stale").otherwise("current")


def compact_date(stamp: Column) -> Column:
    """yyyymmdd... to yyyy-mm-dd by cutting; empty for shorter text."""
    return F.when(F.length(stamp) >= 8, F.concat_ws("-", F.substring(stamp, 1, 4), F.substring(stamp, 5, 2), F.substring(stamp, 7, 2))).otherwise("")


def month_label(ts: Column) -> Column:
    return F.concat(F.lit("as of "), F.date_format(ts, "MMM yyyy"))


def trusted_stamp(client: Column, server: Column, seconds: int = CLOCK_TRUST_SECONDS) -> Column:
    """The client's clock where it is within the bound of the server's, else the server's."""
    return F.when(F.abs(F.unix_timestamp(client) - F.unix_timestamp(server)) <= seconds, client).otherwise(server)


def two_digit_year(year: Column, as_of_year: int) -> Column:
    """Full year of a two-digit one: over 30 is last century; a birth year that makes someone too young moves back."""
    full = F.when(year > 30, 1900 + year).otherwise(2000 + year)
    return F.when(full > as_of_year - 18, full - 100).otherwise(full)


def birth_year(text: Column, as_of_year: int) -> Column:
    """Year of a month/day/year date with two or four digits; null if there is none."""
    year = F.regexp_extract(text, r"^\s*[0-9]{1,2}/[0-9]{1,2}/([0-9]{4}|[0-9]{2})\s*$", 1)
    number = year.try_cast("int")
    return F.when(F.length(year) == 4, number).when(F.length(year) == 2, two_digit_year(number, as_of_year))


def precise_year(time_value: Column, precision: Column) -> Column:
    """Year of a signed ISO stamp if it is precise to the year at least."""
    return F.when(precision >= 9, F.regexp_extract(time_value, r"^\+?([0-9]{4})-", 1).try_cast("int"))


def implausible_birth(born: Column, as_of_year: int) -> Column:
    """A birth year that is missing, absurdly early, or that makes someone a minor today: it proves nothing."""
    return F.coalesce(~born.between(1850, as_of_year - ADULT), F.lit(True))


def impossible_record(first_year: Column, born: Column, as_of_year: int) -> Column:
    """A contribution before the age of 18; false on any doubt of the birth year or of the year of the contribution."""
    sure = ~implausible_birth(born, as_of_year) & first_year.between(1850, as_of_year)
    return F.coalesce(sure & (first_year < born + ADULT), F.lit(False))


def first_year_of(span: Column) -> Column:
    """The year with which a span ``yyyy-mm-dd to yyyy-mm-dd`` begins; null for any other text."""
    return F.when(span.contains(" to "), F.substring(F.split(span, " to ")[0], 1, 4).try_cast("int"))


def window_of(dates: Column) -> Column:
    """Struct of the least and greatest well-formed ISO day in an array; null if there is none."""
    good = F.array_sort(F.filter(dates, lambda d: d.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")))
    return F.when(F.size(good) > 0, F.struct(F.get(good, 0).alias("first"), F.element_at(good, -1).alias("last")))


def recent(ts: Column, as_of: Column, days: int) -> Column:
    """Not older than so many days; rows without a readable date pass."""
    return ts.isNull() | (days_between(ts, as_of) <= days)
