"""Time columns and range guards.  Timestamps are UTC instants; the session time zone is UTC."""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def utc_range(start: datetime, end: datetime) -> tuple[datetime, datetime]:
    """Both bounds in UTC; naive bounds and start after end are errors."""
    for bound in (start, end):
        if bound.tzinfo is None or bound.utcoffset() is None:
            raise ValueError(f"{bound} has no time zone")
    start, end = start.astimezone(UTC), end.astimezone(UTC)
    if start > end:
        raise ValueError(f"start {start} is after end {end}")
    return start, end


def require_instants(df: DataFrame, column: str) -> DataFrame:
    """df, if the column is a TimestampType and not a zoneless one."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.TimestampType):
        raise TypeError(f"{column} is {kind.simpleString()}, not timestamp")
    return df


def next_midnight(end: date) -> date:
    """Exclusive bound that keeps daily bars of the end day."""
    return (end.date() if isinstance(end, datetime) else end) + timedelta(days=1)


def before_day_end(ts: Column, end: Column) -> Column:
    """ts lies on or before the day of `end`."""
    return ts < F.date_add(F.to_date(end), 1)


def day_of(ts: Column) -> Column:
    return F.to_date(ts)


def midnight(ts: Column) -> Column:
    return F.date_trunc("DAY", ts)


def parse_instant(text: Column) -> Column:
    """ISO date or date-time, with `T` or a blank, `Z`, an offset or none; else null."""
    return F.try_to_timestamp(text)


def parse_compact(text: Column) -> Column:
    """YYYYMMDDTHHMM with optional seconds; else null."""
    known = text.rlike(r"^\d{8}T\d{4}(\d{2})?$")
    form = F.concat(F.substring(text, 1, 8), F.substring(text, 10, 4), F.rpad(F.substring(text, 14, 2), 2, "0"))
    return F.when(known, F.try_to_timestamp(form, F.lit("yyyyMMddHHmmss")))


def parse_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def parse_day(text: Column) -> Column:
    """Strict yyyy-MM-dd; else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast("date")


def relative_time(text: Column, now: Column) -> Column:
    """ "5 minutes ago" and the like against `now`, a date otherwise; null if neither can be read."""
    n = F.try_to_number(F.regexp_extract(text, r"(\d+)", 1), F.lit("999999999")).cast("int")
    low = F.lower(text)
    first = F.coalesce(n, F.when(low.rlike(r"\ban?\b"), 1))
    back = lambda unit: F.timestamp_add(unit, -first, now)
    return (
        F.when(low.contains("minute"), back("MINUTE"))
        .when(low.contains("hour"), back("HOUR"))
        .when(low.contains("day"), back("DAY"))
        .otherwise(parse_instant(text))
    )


def effective_day(reported: Column, fiscal_end: Column, delay: int = 45) -> Column:
    """From when a report is known: its reporting date, else `delay` days after the fiscal date."""
    return F.coalesce(reported, F.date_add(fiscal_end, delay))


def day_of_week(ts: Column) -> Column:
    """Monday 0 to Sunday 6."""
    return F.weekday(ts).cast("long")


def month(ts: Column) -> Column:
    return F.month(ts).cast("long")
