"""The jobs end to end: stored tables in, stored tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfare.operators import booking, cart, changes, fares, quality, schedule, search
from wayfare.session import stage
from wayfare.sources import tables
from wayfare.sources.manifest import Store


def build_timetable(spark: SparkSession, root: str, out: str) -> dict[str, DataFrame]:
    """Timetable to dated flights to fares, from the tables under ``root`` into ``out``.

    Fares whose class has no seat count are kept apart in ``refused_fares``. Returns the stored
    tables and ``report``, the broken rules among them.
    """
    airports = tables.read_table(spark, "airport", f"{root}/airport")
    airlines = tables.read_table(spark, "airline", f"{root}/airline")
    classes = tables.read_table(spark, "class", f"{root}/class")
    entries = tables.read_table(spark, "flight_schedule", f"{root}/flight_schedule")

    tables.write_flights(schedule.expand_schedule(entries, airports), f"{out}/flight")
    flights = tables.read_flights(spark, f"{out}/flight")

    good, refused = fares.split_fares(fares.price_flights(flights, airports, classes))
    tables.write_fares(good, f"{out}/flight_class")
    tables.write_fares(refused, f"{out}/refused_fares")
    stored = tables.read_fares(spark, f"{out}/flight_class")

    checked = {
        "airport": airports,
        "airline": airlines,
        "class": classes,
        "flight_schedule": entries,
        "flight": flights,
        "flight_class": stored,
    }
    return {"flight": flights, "flight_class": stored, "report": quality.integrity_report(checked)}


def save_for_joins(
    flights: DataFrame, prices: DataFrame, tickets: DataFrame, prefix: str, path: str, buckets: int = 8
) -> None:
    """Save catalog tables ``prefix``_flight, _fares and _ticket, all bucketed by flight: none of the joins of
    :func:`stored_receipts` shuffles one of them again."""
    tables.save_bucketed(flights, f"{prefix}_flight", ["id"], buckets, path=f"{path}/flight")
    tables.save_bucketed(tables.fares_by_flight(prices), f"{prefix}_fares", ["flight_id"], buckets, path=f"{path}/fares")
    tables.save_bucketed(tickets, f"{prefix}_ticket", ["flight"], buckets, path=f"{path}/ticket")


def stored_receipts(spark: SparkSession, prefix: str, classes: DataFrame) -> DataFrame:
    """Receipts of all tickets from the tables of :func:`save_for_joins`, with the fare as it is now."""
    held = spark.table(f"{prefix}_ticket").selectExpr("id as ticket_id", "customer_id", "flight as flight_id", "class_id")
    met = held.join(spark.table(f"{prefix}_fares"), "flight_id")
    own = "inline(filter(fares, f -> f.class_id = class_id))"
    priced = met.selectExpr("ticket_id", "customer_id", "flight_id", own).drop("capacity")
    return cart.fare_details(priced, spark.table(f"{prefix}_flight"), classes)


def answer_searches(
    forms: DataFrame,
    customers: DataFrame,
    flights: DataFrame,
    prices: DataFrame,
    today: str,
    out: str,
    times: DataFrame | None = None,
) -> None:
    """Search forms to ranked itineraries under ``out``, with refused and unanswered forms. ``times`` are
    those stored with the flights."""
    requests, refused = search.resolve_requests(forms, customers, today)
    usable, offered = search.within_horizon(flights, requests, times=times), prices
    if "departure_date" in prices.columns:
        offered = search.fares_of(prices, usable)
    search.ranked_itineraries(requests, usable, offered).write.mode("overwrite").parquet(f"{out}/itineraries")
    found = forms.sparkSession.read.parquet(f"{out}/itineraries")
    search.unmatched_requests(requests, found).write.mode("overwrite").parquet(f"{out}/unanswered")
    refused.write.mode("overwrite").parquet(f"{out}/refused")


def book_carts(carts: DataFrame, prices: DataFrame, out: str, run: str) -> None:
    """Book carts into the ticket store ``out``, with what is refused; a repeated run adds nothing."""
    tickets, refused = booking.settle(stage(booking.priced_cart(carts, prices), "priced-carts"))
    Store(carts.sparkSession, out).append({"ticket": tickets, "refused": refused}, run)


def update_accounts(stored: dict[str, DataFrame], log: DataFrame, out: str) -> None:
    """Write new versions of the account tables after a change log."""
    for name, table in changes.apply_changes(stored, log).items():
        table.write.mode("overwrite").parquet(f"{out}/{name}")
