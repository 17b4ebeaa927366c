"""Weekday masks, wall-clock times and time buckets, all free of time zones.

Arguments named as text are column names or SQL expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days from 0001-01-01 to 1970-01-01.
_DAYS_BEFORE_EPOCH = 719162


def bit_positions(mask: str) -> Column:
    """Zero-based positions of '1' in a bit string; NULL when there are none."""
    found = f"filter(sequence(0, greatest(length({mask}) - 1, 0)), i -> substring({mask}, i + 1, 1) = '1')"
    return F.expr(f"case when size({found}) > 0 then {found} end")


def weekday(day: str) -> Column:
    """Day of the week with Sunday as 0."""
    return F.expr(f"dayofweek({day}) - 1")


def runs_on(mask: str, day: str) -> Column:
    """Whether a Sunday-first mask is set on the day's weekday."""
    return F.expr(f"substring({mask}, dayofweek({day}), 1) = '1'")


def minutes(count: str | int) -> Column:
    return F.expr(f"make_dt_interval(0, 0, cast({count} as int))")


def interval_minutes(interval: str) -> Column:
    """Whole minutes of a day-time interval."""
    return F.expr(
        f"cast(extract(day from {interval}) * 1440 + extract(hour from {interval}) * 60"
        f" + extract(minute from {interval}) as int)"
    )


def at_minute(day: str, minute_of_day: str) -> Column:
    """Wall-clock timestamp at a minute of a day."""
    return F.expr(f"cast({day} as timestamp_ntz) + make_dt_interval(0, 0, cast({minute_of_day} as int))")


def day_number(day: str) -> Column:
    """Days since 0001-01-01."""
    return F.expr(f"unix_date({day}) + {_DAYS_BEFORE_EPOCH}")


def time_bucket_sql(ts: str, width_minutes: int) -> str:
    """SQL for the number of the fixed-width bucket a wall-clock timestamp falls in."""
    minute = f"(unix_date(cast({ts} as date)) * 1440 + hour({ts}) * 60 + minute({ts}))"
    return f"cast(floor({minute} / {width_minutes}) as int)"


def buckets_between(first: str, last: str, width_minutes: int) -> Column:
    """Array of all bucket numbers from one timestamp to another, which must not be earlier."""
    return F.expr(
        f"sequence({time_bucket_sql(first, width_minutes)}, {time_bucket_sql(last, width_minutes)})"
    )
