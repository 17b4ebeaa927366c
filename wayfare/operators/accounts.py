"""Account lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.functions.labels import address_label
from wayfare.operators.email_index import match_patterns

_ADDRESS = ["line_1", "line_2", "city", "province", "postal_code", "country"]


def customers_by_email(
    wanted: DataFrame, customers: DataFrame, match: str = "equal", index: DataFrame | None = None
) -> DataFrame:
    """Customers for each ``email`` in ``wanted``, ignoring case.

    ``equal`` compares the whole address. ``pattern`` also lets ``%`` and ``_`` in the wanted
    address stand for any text and any character, found by ``index`` (see ``email_index``) or one built
    for the purpose. Several customers may share an address.
    """
    left = wanted.select(F.col("email").alias("wanted_email"))
    right = customers.select("id", "name", "email")
    if match == "equal":
        return left.join(right, F.lower("wanted_email") == F.lower("email")).select("wanted_email", "id", "name")
    if match != "pattern":
        raise ValueError(f"unknown match {match!r}")
    # Only wanted addresses with a wildcard need their pattern tried.
    has_wildcard = F.col("wanted_email").rlike(r"[%_\\]")
    plain = left.filter(~has_wildcard).join(right, F.lower("wanted_email") == F.lower("email"))
    tried = match_patterns(left.filter(has_wildcard), right, index)
    return plain.select("wanted_email", "id", "name").unionByName(tried)


def duplicate_emails(customers: DataFrame) -> DataFrame:
    """Addresses, ignoring case, held by more than one customer."""
    return (
        customers.groupBy(F.lower("email").alias("email"))
        .agg(F.count("*").alias("customers"))
        .filter(F.col("customers") > 1)
    )


def primaries(customers: DataFrame) -> DataFrame:
    return customers.select("id", "primary_payment_id", "primary_address_id")


def payment_methods(customers: DataFrame, payments: DataFrame) -> DataFrame:
    """Payment methods of the given customers, with a flag on the primary one."""
    who = customers.select(F.col("id").alias("customer_id"), "primary_payment_id")
    return payments.join(who, "customer_id").select(
        "customer_id",
        "id",
        "display_name",
        F.col("id").eqNullSafe(F.col("primary_payment_id")).alias("is_primary"),
    )


def address_book(customers: DataFrame, links: DataFrame, addresses: DataFrame) -> DataFrame:
    """Linked addresses of the given customers; a link to a missing address keeps its row.

    Written as the full outer join it is. The filter on the link side lets Spark turn it into a
    left outer join.
    """
    who = customers.select(F.col("id").alias("customer_id"), "primary_address_id")
    joined = (
        links.alias("l")
        .join(addresses.alias("a"), F.col("l.address_id") == F.col("a.id"), "full")
        .filter(F.col("l.customer_id").isNotNull())
        .select("l.customer_id", F.col("l.address_id").alias("id"), *[f"a.{c}" for c in _ADDRESS])
    )
    return joined.join(who, "customer_id").select(
        "customer_id",
        "id",
        *_ADDRESS,
        F.col("id").eqNullSafe(F.col("primary_address_id")).alias("is_primary"),
        _label(" ").alias("label"),
    )


def checkout_addresses(customers: DataFrame, links: DataFrame, addresses: DataFrame) -> DataFrame:
    """The addresses offered at checkout, with both key columns: the link's and the address's."""
    who = customers.select(F.col("id").alias("customer_id"), "primary_address_id")
    found = addresses.select(F.col("id").alias("address_key"), *_ADDRESS)
    return (
        links.join(who, "customer_id")
        .join(found, F.col("address_id") == F.col("address_key"), "left")
        .select(
            "customer_id",
            "address_id",
            "address_key",
            *_ADDRESS,
            F.col("address_id").eqNullSafe(F.col("primary_address_id")).alias("is_primary"),
            _label(", ").alias("label"),
        )
    )


def _label(before_country: str):
    return address_label(*[F.col(c) for c in _ADDRESS], before_country=before_country)
