"""Periods of days: Monday weeks, matched comparison periods and their bounds, on the driver; and their columns."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Period:
    current_start: date
    current_end: date
    previous_start: date
    previous_end: date

    def current(self, day: str = "local_date") -> Column:
        return F.col(day).between(F.lit(self.current_start), F.lit(self.current_end))

    def previous(self, day: str = "local_date") -> Column:
        return F.col(day).between(F.lit(self.previous_start), F.lit(self.previous_end))


def monday(day: date) -> date:
    return day - timedelta(days=day.weekday())


def default_period(today: date) -> Period:
    """Monday to today, against the same days a week before."""
    week = timedelta(days=7)
    return Period(monday(today), today, monday(today) - week, today - week)


def custom_period(start: date | None, end: date | None, earliest: date | None, latest: date | None, today: date) -> Period:
    """The given days, against as many right before. An open side takes the data's bounds, no later than today; inverted bounds become one day."""
    if start and end and start > end:
        raise ValueError("the period ends before it starts")
    if start is None and end is None:
        return default_period(today)
    first = start or min(earliest or end, end)
    last = end or min(latest or today, today)
    if last < first:
        first = last = start or end
    days = timedelta(days=(last - first).days + 1)
    return Period(first, last, first - days, last - days)


def trend_weeks(today: date, start: date | None = None, end: date | None = None, weeks: int = 12) -> tuple[date, date]:
    """(first, last) Monday of a dense trend."""
    last = monday(end or today)
    first = last - timedelta(days=7 * (weeks - 1))
    if start:
        first = max(first, monday(start))
    if (last - first).days > 53 * 7:
        raise ValueError("a trend covers 53 weeks at most")
    return first, last


def utc_wall(epoch: Column) -> Column:
    """An instant as date and time in UTC, whatever the session's zone."""
    return F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(F.floor(epoch / 86400).cast("int"), F.lit(0), F.lit(0), F.pmod(epoch, F.lit(86400)).cast("decimal(18,6)"))


def utc_text(epoch: Column) -> Column:
    """An instant of whole seconds as ISO text with milliseconds."""
    return F.concat(F.replace(utc_wall(epoch).cast("string"), F.lit(" "), F.lit("T")), F.lit(".000Z"))


def local_date(epoch: Column, zone: str) -> Column:
    """The calendar day of an instant in a named zone, with its daylight saving, whatever the session's zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc_wall(epoch)).cast("date")


def week_start(day: Column) -> Column:
    return F.to_date(F.date_trunc("week", day))
