"""Logs of account changes applied to whole tables.

A log has ``seq`` (unique, growing), ``customer_id`` and ``action``, and the payload columns each
function names. For every key the newest change wins, so batches may arrive in any order and
more than once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.constants import CARD_LABEL_PREFIX
from wayfare.functions.labels import card_label

LINK = ["customer_id", "address_id"]


# -- links and primaries ----------------------------------------------------


def newest_link_changes(log: DataFrame) -> DataFrame:
    """Newest add or remove per customer and address (``target_id``)."""
    return (
        log.filter(F.col("action").isin("add_address", "remove_address"))
        .groupBy("customer_id", F.col("target_id").alias("address_id"))
        .agg(F.max("seq").alias("seq"), F.max_by("action", "seq").alias("action"))
    )


def apply_address_links(links: DataFrame, log: DataFrame) -> DataFrame:
    """Customer-address links after the log. Linking twice keeps one link; removing an absent
    link changes nothing."""
    newest = newest_link_changes(log)
    kept = links.select(*LINK).join(newest.select(*LINK), LINK, "left_anti")
    return kept.unionByName(newest.filter(F.col("action") == "add_address").select(*LINK))


def apply_primaries(customers: DataFrame, log: DataFrame) -> DataFrame:
    """Customers with the primary address and payment method last chosen in the log."""
    address = F.when(F.col("action") == "set_primary_address", F.col("seq"))
    payment = F.when(F.col("action") == "set_primary_payment", F.col("seq"))
    newest = (
        log.filter(F.col("action").isin("set_primary_address", "set_primary_payment"))
        .groupBy(F.col("customer_id").alias("id"))
        .agg(
            F.max(address).alias("_address_seq"),
            F.max_by("target_id", address).alias("_address"),
            F.max(payment).alias("_payment_seq"),
            F.max_by("target_id", payment).alias("_payment"),
        )
    )

    def chosen(seq: str, new: str, old: str):
        return F.when(F.col(seq).isNotNull(), F.col(new)).otherwise(F.col(old)).alias(old)

    replaced = {
        "primary_address_id": chosen("_address_seq", "_address", "primary_address_id"),
        "primary_payment_id": chosen("_payment_seq", "_payment", "primary_payment_id"),
    }
    return customers.join(newest, "id", "left").select(
        *[replaced.get(c, F.col(c)) for c in customers.columns]
    )


# -- new rows ---------------------------------------------------------------


def onboard_customers(
    forms: DataFrame, airports: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Registrations to (addresses, customers, links, refused forms).

    ``forms``: customer_id and address_id (new keys), name, email, addr, city, province, post,
    country, home. An unknown home airport refuses the form.
    """
    known = airports.select(F.col("iata").alias("home"))
    good = forms.join(known, "home", "left_semi")
    refused = forms.join(known, "home", "left_anti").select("customer_id", "email", "home")
    addresses = good.select(
        F.col("address_id").alias("id"),
        F.col("addr").alias("line_1"),
        F.lit("").alias("line_2"),
        "city",
        "province",
        F.col("post").alias("postal_code"),
        "country",
    )
    customers = good.select(
        F.col("customer_id").alias("id"),
        "name",
        "email",
        F.lit(None).cast("bigint").alias("primary_payment_id"),
        F.col("address_id").alias("primary_address_id"),
        F.col("home").alias("primary_airport_id"),
    )
    return addresses, customers, good.select(*LINK), refused


def add_addresses(forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Address forms to (addresses, links). A missing second line is stored as empty text.

    ``forms``: customer_id, address_id (new key), line1, line2, city, province, post, country.
    """
    addresses = forms.select(
        F.col("address_id").alias("id"),
        F.col("line1").alias("line_1"),
        F.coalesce("line2", F.lit("")).alias("line_2"),
        "city",
        "province",
        F.col("post").alias("postal_code"),
        "country",
    )
    return addresses, forms.select(*LINK)


def add_payments(forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Payment forms to (payment methods, refused forms with a reason).

    ``forms``: payment_id (new key), customer_id, card_number, exp_year and exp_month (text),
    card_holder, address_id. Only the label made from the card number is kept.
    """
    year = F.trim("exp_year").try_cast("int")
    month = F.trim("exp_month").try_cast("int")
    read = forms.withColumn("_year", year).withColumn("_month", month)
    reason = (
        F.when(F.col("_year").isNull(), "year is not a number")
        .when(F.col("_month").isNull(), "month is not a number")
        .when(~F.col("_month").between(1, 12) | ~F.col("_year").between(1, 9999), "no such date")
    )
    read = read.withColumn("reason", reason)
    good = read.filter(F.col("reason").isNull()).select(
        F.col("payment_id").alias("id"),
        "customer_id",
        F.make_date("_year", "_month", F.lit(1)).alias("exp"),
        "card_holder",
        card_label(F.col("card_number"), CARD_LABEL_PREFIX).alias("display_name"),
        F.col("address_id").alias("billing_address"),
    )
    refused = read.filter(F.col("reason").isNotNull()).select("payment_id", "customer_id", "reason")
    return good, refused


def readable_payments(forms: DataFrame) -> DataFrame:
    """The payment forms that :func:`add_payments` does not refuse."""
    year, month = (F.trim(c).try_cast("int") for c in ("exp_year", "exp_month"))
    return forms.filter(year.between(1, 9999) & month.between(1, 12))


def remove_payments(payments: DataFrame, log: DataFrame) -> DataFrame:
    """Payment methods left after removals (``target_id``) by their own customer. The rows of
    ``payments`` count as older than the log."""
    removed = (
        log.filter(F.col("action") == "remove_payment")
        .select(F.col("target_id").alias("id"), "customer_id")
        .distinct()
    )
    return payments.join(removed, ["id", "customer_id"], "left_anti").select(*payments.columns)


_FORM = [
    "line1",
    "line2",
    "city",
    "province",
    "post",
    "country",
    "card_number",
    "exp_year",
    "exp_month",
    "card_holder",
    "address_id",
]


def newest_forms(log: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of ``log`` per ``keys``, with its form columns."""
    form = F.struct(*[F.col(c) for c in _FORM if c in log.columns])
    newest = log.groupBy(*keys).agg(F.max("seq").alias("seq"), F.max_by(form, "seq").alias("_form"))
    return newest.select(*keys, "seq", "_form.*")


def apply_addresses(addresses: DataFrame, log: DataFrame) -> DataFrame:
    """Addresses after the log: the newest form of an added address replaces what is stored."""
    forms = newest_forms(
        log.filter((F.col("action") == "add_address") & F.col("line1").isNotNull()), ["target_id"]
    ).withColumns({"address_id": F.col("target_id"), "customer_id": F.lit(None).cast("bigint")})
    added, _ = add_addresses(forms)
    kept = addresses.join(added.select("id"), "id", "left_anti").select(*addresses.columns)
    return kept.unionByName(added.select(*addresses.columns))


def apply_payments(payments: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(payment methods after the log, refused forms).

    Per method and customer the newest change wins: an addition replaces what is stored, a removal
    takes it away. Refused forms change nothing.
    """
    adds = log.filter(F.col("action") == "add_payment").withColumn("payment_id", F.col("target_id"))
    _, refused = add_payments(adds)
    # Of one key's forms only readable ones may be the newest.
    forms = newest_forms(readable_payments(adds), ["payment_id", "customer_id"])
    removals = (
        log.filter(F.col("action") == "remove_payment")
        .groupBy(F.col("target_id").alias("payment_id"), "customer_id")
        .agg(F.max("seq").alias("_removed"))
    )
    alive = forms.join(removals, ["payment_id", "customer_id"], "left").filter(
        F.col("_removed").isNull() | (F.col("_removed") < F.col("seq"))
    )
    added, _ = add_payments(alive)
    touched = forms.select(F.col("payment_id").alias("id"), "customer_id").unionByName(
        removals.select(F.col("payment_id").alias("id"), "customer_id")
    )
    kept = payments.join(touched.distinct(), ["id", "customer_id"], "left_anti").select(*payments.columns)
    return kept.unionByName(added.select(*payments.columns)), refused.distinct()


# -- all tables at once -----------------------------------------------------


def apply_changes(tables: dict[str, DataFrame], log: DataFrame) -> dict[str, DataFrame]:
    """New versions of customer, address, customer_address and payment_method after ``log``.

    Besides seq, customer_id, action and target_id, the log carries the form columns line1,
    line2, city, province, post, country, card_number, exp_year, exp_month and card_holder. The
    new key of an added address or payment method is its ``target_id``; for add_payment the
    billing address is ``address_id``. The key ``refused_payment`` holds refused forms. Applying a
    log to its own result changes nothing.
    """
    payments, refused = apply_payments(tables["payment_method"], log)
    return {
        "customer": apply_primaries(tables["customer"], log),
        "address": apply_addresses(tables["address"], log),
        "customer_address": apply_address_links(tables["customer_address"], log),
        "payment_method": payments,
        "refused_payment": refused,
    }
