"""Flights to fares per cabin class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.constants import CABIN_CLASSES, MONEY
from wayfare.functions.geo import airport_trig, trig_miles
from wayfare.functions.money import money, ticket_price


def cabin_capacity(class_id: str) -> Column:
    """Seats of a cabin class; NULL for a class without a fixed layout."""
    cases = " ".join(f"when {known} then {seats}" for known, _, _, seats in CABIN_CLASSES)
    return F.expr(f"case {class_id} {cases} end")


def flight_miles(flights: DataFrame, airports: DataFrame, mode: str = "reference") -> DataFrame:
    """Flights with their great-circle ``miles``; flights with an unknown airport drop out.

    The airport table is small in practice, so Spark broadcasts it by its own size check and the
    flights are never shuffled.
    """
    start = airport_trig(airports, "from")
    end = airport_trig(airports, "to")
    return (
        flights.join(start, F.col("departure_airport") == F.col("from_iata"))
        .join(end, F.col("arrival_airport") == F.col("to_iata"))
        .select(*flights.columns, trig_miles("from", "to", mode).alias("miles"))
    )


def with_each_class(df: DataFrame, classes: DataFrame) -> DataFrame:
    """Every row once per cabin class, adding ``class_id`` and ``fee``.

    A fare is wanted for every pair, so this is a cross join. The class list is the small side, and
    Spark's own size check broadcasts it.
    """
    wanted = classes.filter("id is not null").selectExpr(
        "cast(id as int) as class_id", f"cast(fee as {MONEY}) as fee"
    )
    return df.crossJoin(wanted)


def price_flights(
    flights: DataFrame, airports: DataFrame, classes: DataFrame, mode: str = "reference"
) -> DataFrame:
    """One fare per flight and cabin class: distance price plus the class fee, and the seats.

    Flights as they are stored have a ``departure_date``, which their fares then get too, so that
    both can be stored and pruned by it.
    """
    dated = [c for c in ("departure_date",) if c in flights.columns]
    priced = flight_miles(flights, airports, mode).select(
        F.col("id").alias("flight_id"), ticket_price(F.col("miles")).alias("base"), *dated
    )
    return with_each_class(priced, classes).select(
        "flight_id",
        "class_id",
        cabin_capacity("class_id").alias("capacity"),
        money(F.col("base") + F.col("fee")).alias("price"),
        *dated,
    )


def split_fares(fares: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(storable fares, fares refused because their class has no seat count)."""
    return fares.filter(F.col("capacity").isNotNull()), fares.filter(F.col("capacity").isNull())
