"""Weekly timetables to dated flights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions.calendar import at_minute, day_number, runs_on

# A flight id holds the schedule id above the day number, which needs 20 bits up to year 2871.
_DAY_BITS = 20


def flight_id(schedule_id: str, day: str) -> Column:
    """Collision-free id of one schedule on one day, the same on every run."""
    number = day_number(day)
    fits = F.col(schedule_id).between(0, 2 ** (63 - _DAY_BITS) - 1) & number.between(0, 2**_DAY_BITS - 1)
    return F.when(fits, F.shiftleft(F.col(schedule_id).cast("bigint"), _DAY_BITS) + number).otherwise(
        F.raise_error(F.lit("schedule id or date too large for a flight id")).cast("bigint")
    )


def expand_schedule(schedule: DataFrame, airports: DataFrame) -> DataFrame:
    """One flight per schedule and running day, for schedules whose two airports are known.

    ``valid_to`` is exclusive. An empty or open range yields no flights. An arrival clock
    before the departure clock means the next day; equal clocks mean the same day.
    """
    known = airports.select("iata")
    # Ranges are checked before the sequence is built: Spark counts downwards when it ends
    # before it starts. Both airport filters run before the rows multiply.
    days = (
        schedule.filter(F.col("valid_to") > F.col("valid_from"))
        .join(known.withColumnRenamed("iata", "departure_airport"), "departure_airport", "left_semi")
        .join(known.withColumnRenamed("iata", "arrival_airport"), "arrival_airport", "left_semi")
        .withColumn("day", F.explode(F.sequence("valid_from", F.date_sub("valid_to", 1))))
        .filter(runs_on("days", "day"))
    )
    arrival_day = "date_add(day, cast(arrival_min < departure_min as int))"
    return days.select(
        flight_id("id", "day").alias("id"),
        "airline",
        "number",
        at_minute("day", "departure_min").alias("departure_time"),
        at_minute(arrival_day, "arrival_min").alias("arrival_time"),
        "duration",
        "departure_airport",
        "arrival_airport",
    )


def duration_audit(flights: DataFrame, hours: int = 12) -> DataFrame:
    """Flights whose clock times disagree with their stated duration by more than ``hours``.

    The next-day rule looks only at clocks, so a short hop west across time zones can gain a
    day; this lists the flights it may have touched.
    """
    stated = F.col("duration")
    gap = (F.col("arrival_time") - F.col("departure_time")) - stated
    limit = F.make_dt_interval(hours=F.lit(hours))
    return flights.filter((gap > limit) | (gap < -limit)).select(
        "id", "airline", "number", "departure_time", "arrival_time", "duration"
    )
