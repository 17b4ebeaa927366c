"""Carts to tickets, receipts and ticket history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions.money import money
from wayfare.operators.cart import PAIR, fare_details

# A ticket id holds the cart id above the position in the cart.
POSITION_BITS = 20


def ticket_id(cart_id: Column, seq: Column) -> Column:
    """Collision-free id, the same on every run, so booking a cart twice gives equal tickets."""
    in_range = (seq >= 0) & (seq < 2**POSITION_BITS) & (cart_id >= 0) & (cart_id < 2 ** (63 - POSITION_BITS))
    return F.when(in_range, F.shiftleft(cart_id.cast("bigint"), POSITION_BITS) + seq).otherwise(
        F.raise_error(F.lit("cart id or position too large for a ticket id")).cast("bigint")
    )


def first_ticket(cart_id: int) -> int:
    """The smallest id that a ticket of a cart can have."""
    return cart_id << POSITION_BITS


def last_ticket(cart_id: int) -> int:
    """The largest id that a ticket of a cart can have."""
    return first_ticket(cart_id + 1) - 1


def priced_cart(cart: DataFrame, fares: DataFrame) -> DataFrame:
    """Cart rows with the price of their exact flight and class, NULL where there is none."""
    return cart.join(fares.select(*PAIR, "price"), PAIR, "left").select(*cart.columns, "price")


def book_tickets(
    cart: DataFrame, fares: DataFrame, leg_mode: str = "position"
) -> tuple[DataFrame, DataFrame]:
    """Book all carts at once, each as a whole or not at all.

    ``cart``: cart_id, customer_id, seq (position in the cart), flight_id, class_id, paid_with.
    One entry without a price, or without a payment method, refuses the whole cart. The ``leg``
    of a ticket is its position in the cart, or always 0 with ``leg_mode="zero"``.

    Returns (tickets, rows of refused carts with the reason at the failing row).
    """
    return settle(priced_cart(cart, fares), leg_mode)


def settle(priced: DataFrame, leg_mode: str = "position") -> tuple[DataFrame, DataFrame]:
    """Tickets and refused rows of a priced cart table. A job that stores both may stage the
    priced carts first, so that they meet the fares once."""
    reason = F.when(F.col("price").isNull(), "no price").when(F.col("paid_with").isNull(), "no payment method")
    # The failing carts are reduced to distinct ids before they meet the cart rows again. Two entries
    # at one position would get one ticket id.
    places = priced.groupBy("cart_id", "seq").agg(F.count("*").alias("n"), F.bool_or(reason.isNotNull()).alias("bad"))
    failing = places.groupBy("cart_id").agg(F.bool_or("bad").alias("bad"), F.bool_or(F.col("n") > 1).alias("twice"))
    failing = failing.filter("bad or twice").select("cart_id", "twice")
    leg = F.lit(0) if leg_mode == "zero" else F.col("seq").cast("int")
    tickets = priced.join(failing, "cart_id", "left_anti").select(
        ticket_id(F.col("cart_id"), F.col("seq")).alias("id"),
        "price",
        leg.alias("leg"),
        F.col("flight_id").alias("flight"),
        "customer_id",
        "paid_with",
        "class_id",
    )
    refused = priced.join(failing, "cart_id").select(
        "cart_id",
        "customer_id",
        "seq",
        *PAIR,
        F.coalesce(reason, F.when(F.col("twice"), "position used twice")).alias("reason"),
    )
    return tickets, refused


def receipts(
    tickets: DataFrame,
    flights: DataFrame,
    fares: DataFrame,
    classes: DataFrame,
    ticket_ids: DataFrame | None = None,
) -> DataFrame:
    """Details of tickets with the fare as it is now, for the ids in ``ticket_ids`` (id) or all."""
    if ticket_ids is not None:
        tickets = tickets.join(ticket_ids.select("id"), "id", "left_semi")
    held = tickets.select(
        F.col("id").alias("ticket_id"), "customer_id", F.col("flight").alias("flight_id"), "class_id"
    )
    priced = held.join(fares.select(*PAIR, "price"), PAIR)
    return fare_details(priced, flights, classes)


def ticket_history(
    tickets: DataFrame,
    flights: DataFrame,
    fares: DataFrame,
    classes: DataFrame,
    customers: DataFrame | None = None,
) -> DataFrame:
    """All tickets of the customers in ``customers`` (customer_id), or of everybody."""
    if customers is not None:
        tickets = tickets.join(customers.select("customer_id"), "customer_id", "left_semi")
    return receipts(tickets, flights, fares, classes)


def receipt_total(receipt: DataFrame, by: list[str]) -> DataFrame:
    return receipt.groupBy(*by).agg(money(F.sum("price")).alias("total"))
