"""Shopping carts: from booking tags or cart events to priced, totalled carts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.constants import MONEY
from wayfare.functions.money import money
from wayfare.operators.ranking import number_within
from wayfare.session import stage

PAIR = ["flight_id", "class_id"]


# -- booking tags -----------------------------------------------------------


def _tag_pairs() -> Column:
    # Read as text: a class id picked in a form arrives quoted.
    return F.from_json("tag", "array<array<string>>")


def _tag_number(position: int) -> Column:
    return F.get("_pair", F.lit(position)).try_cast("bigint")


def _tag_is_good() -> Column:
    def good(pair: Column) -> Column:
        return (
            (F.size(pair) == 2)
            & F.get(pair, F.lit(0)).try_cast("bigint").isNotNull()
            & F.get(pair, F.lit(1)).try_cast("int").isNotNull()
        )

    return F.coalesce(F.forall("_pairs", lambda p: F.coalesce(good(p), F.lit(False))), F.lit(False))


def explode_tags(tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tags (cart_id, tag and any other columns) to cart rows, in tag order from 1.

    Returns (cart rows, tags that are not a list of [flight id, class id] pairs).
    """
    read = tags.withColumn("_pairs", _tag_pairs())
    kept = [c for c in tags.columns if c != "tag"]
    rows = (
        read.filter(_tag_is_good())
        .select(*kept, F.posexplode("_pairs").alias("_position", "_pair"))
        .select(
            *kept,
            (F.col("_position") + 1).cast("bigint").alias("seq"),
            _tag_number(0).alias("flight_id"),
            _tag_number(1).cast("int").alias("class_id"),
        )
    )
    return rows, read.filter(~_tag_is_good()).select(*tags.columns)


def carts_from_tags(tags: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Tags that carts took one after another, by the column ``order``, to cart rows numbered from
    1 over the whole cart. ``order`` is unique within a cart. Returns (cart rows, refused tags)."""
    rows, refused = explode_tags(tags)
    rows = rows.withColumnRenamed("seq", "_item")
    kept = [c for c in rows.columns if c not in (order, "_item", *PAIR)]
    return number_within(rows, ["cart_id"], [order, "_item"], "seq").select(*kept, "seq", *PAIR), refused


# -- cart events ------------------------------------------------------------

# Event numbers that are looked through in one task, for any one customer.
SLICE = 1_000_000


def reduce_cart_events(events: DataFrame) -> DataFrame:
    """The part of an event batch that the fold needs: all adds, and per customer and per pair
    only the newest clear and remove. Folding reduced batches equals folding the events."""
    emptied = F.col("action").isin("clear", "checkout")
    adds = events.filter(F.col("action") == "add").select("seq", "customer_id", "action", *PAIR)
    removes = (
        events.filter(F.col("action") == "remove")
        .groupBy("customer_id", *PAIR)
        .agg(F.max("seq").alias("seq"))
        .select("seq", "customer_id", F.lit("remove").alias("action"), *PAIR)
    )
    clears = (
        events.filter(emptied)
        .groupBy("customer_id")
        .agg(F.max("seq").alias("seq"))
        .select(
            "seq",
            "customer_id",
            F.lit("clear").alias("action"),
            F.lit(None).cast("bigint").alias("flight_id"),
            F.lit(None).cast("int").alias("class_id"),
        )
    )
    return adds.unionByName(removes).unionByName(clears)


def cart_state(events: DataFrame) -> DataFrame:
    """Entries still in the carts after all events (seq, customer_id, action, pair).

    What a checkout bought is given by :func:`checked_out_carts`.

    An added entry stays when it is newer than the customer's last clear or checkout and newer
    than the last removal of the same pair. Only sequence numbers are compared, so events may
    come in any order, and an event delivered twice counts once. Both maxima are combined before
    their shuffle, so a very busy customer costs one row there.
    """
    cleared = (
        events.filter(F.col("action").isin("clear", "checkout"))
        .groupBy("customer_id")
        .agg(F.max("seq").alias("_cleared"))
    )
    removed = (
        events.filter(F.col("action") == "remove")
        .groupBy("customer_id", *PAIR)
        .agg(F.max("seq").alias("_removed"))
    )
    adds = events.filter(F.col("action") == "add").select("customer_id", "seq", *PAIR)
    newer_than_clear = F.coalesce(F.col("seq") > F.col("_cleared"), F.lit(True))
    newer_than_remove = F.coalesce(F.col("seq") > F.col("_removed"), F.lit(True))
    return (
        adds.join(cleared, "customer_id", "left")
        .filter(newer_than_clear)
        .join(removed, ["customer_id", *PAIR], "left")
        .filter(newer_than_remove)
        .select("customer_id", "seq", *PAIR)
        .dropDuplicates(["customer_id", "seq"])
    )


def _next_mark(rows: DataFrame, marks: DataFrame, keys: list[str], out: str) -> DataFrame:
    """``rows`` with ``out``, the ``seq`` of the first of ``marks`` after each, of equal ``keys``.

    Event numbers are cut into slices, so a very busy key is spread over tasks. A row without a
    mark in the rest of its slice takes the first one of the next slice that has any.
    """
    cut = F.floor(F.col("seq") / F.lit(SLICE))
    both = rows.withColumn("_mark", F.lit(None).cast("bigint")).unionByName(
        marks.select(*keys, "seq", F.col("seq").alias("_mark")), allowMissingColumns=True
    ).withColumn("_slice", cut)
    later = Window.partitionBy(*keys, "_slice").orderBy(F.col("seq").desc())
    near = both.withColumn("_near", F.min("_mark").over(later.rowsBetween(Window.unboundedPreceding, -1)))
    firsts = marks.groupBy(*keys, cut.alias("_slice")).agg(F.min("seq").alias("_first"))
    # One row per slice that has a row or a mark.
    slices = both.select(*keys, "_slice").distinct().join(firsts, [*keys, "_slice"], "left")
    onward = Window.partitionBy(*keys).orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    far = slices.select(*keys, "_slice", F.min("_first").over(onward).alias("_far"))
    found = near.filter(F.col("_mark").isNull()).join(far, [*keys, "_slice"])
    return found.select(*rows.columns, F.coalesce("_near", "_far").alias(out))


def _added(events: DataFrame) -> DataFrame:
    """Single additions: those of ``add`` events, and of ``add_group`` events with a ``tag``."""
    columns = ["customer_id", "seq", "item", *PAIR]
    single = events.filter(F.col("action") == "add").withColumn("item", F.lit(1).cast("bigint"))
    added = single.select(*columns)
    if "tag" in events.columns:
        groups = events.filter(F.col("action") == "add_group").select("customer_id", F.col("seq").alias("_at"), "tag")
        rows, _ = explode_tags(groups)
        added = added.unionByName(rows.select("customer_id", F.col("_at").alias("seq"), F.col("seq").alias("item"), *PAIR))
    return added.dropDuplicates(["customer_id", "seq", "item"])


def checked_out_carts(events: DataFrame) -> DataFrame:
    """What each checkout bought: cart_id (the checkout's ``seq``), customer_id, seq, pair.

    An added entry is bought by the customer's first checkout after it, unless the cart was
    cleared or the pair removed before. Entries are numbered from 1 in the order in which they
    were added. Events may come in any order, and one delivered twice counts once. An
    ``add_group`` event carries a ``tag`` and appends its entries.
    """
    ends = events.filter(F.col("action").isin("clear", "checkout")).select("customer_id", "seq", "action")
    removals = events.filter(F.col("action") == "remove").select("customer_id", "seq", *PAIR)
    held = _next_mark(_added(events), ends.select("customer_id", "seq").distinct(), ["customer_id"], "_end")
    held = _next_mark(held.filter("_end is not null"), removals.distinct(), ["customer_id", *PAIR], "_gone")
    held = held.filter("_gone is null or _gone > _end")
    checkouts = ends.filter(F.col("action") == "checkout").select(F.col("seq").alias("_end"), "customer_id").distinct()
    bought = held.join(checkouts, ["customer_id", "_end"]).withColumnRenamed("_end", "cart_id")
    bought = bought.withColumnRenamed("seq", "_at")
    return number_within(stage(bought, "bought"), ["cart_id"], ["_at", "item"], "seq").select("cart_id", "customer_id", "seq", *PAIR)


# -- review and totals ------------------------------------------------------


def _cross_pairs(cart: DataFrame, fares: DataFrame) -> DataFrame:
    """Fares whose flight is in the cart and whose class is in the cart, each once per cart.

    Each cart flight meets only its own few fares; a semi join then keeps the cart's classes.
    """
    flights = cart.select("cart_id", "flight_id").distinct()
    classes = cart.select("cart_id", "class_id").distinct()
    return (
        flights.join(fares, "flight_id")
        .join(classes, ["cart_id", "class_id"], "left_semi")
        .select("cart_id", *PAIR, "price")
    )


def cart_fares(cart: DataFrame, fares: DataFrame, pair_mode: str = "exact") -> DataFrame:
    """Fares of each cart: cart_id, flight_id, class_id, price.

    ``exact`` prices every cart entry by its own flight and class. ``cross`` takes every fare
    with any of the cart's flights and any of its classes, each once.
    """
    prices = fares.select(*PAIR, "price")
    if pair_mode == "exact":
        return cart.join(prices, PAIR).select("cart_id", *PAIR, "price")
    if pair_mode == "cross":
        return _cross_pairs(cart, prices)
    raise ValueError(f"unknown pair mode {pair_mode!r}")


def fare_details(priced: DataFrame, flights: DataFrame, classes: DataFrame) -> DataFrame:
    """Add the flight's details and the class name to rows with flight_id, class_id, price."""
    own = [c for c in priced.columns if c not in (*PAIR, "price")]
    shown = flights.select(
        F.col("id").alias("flight_id"),
        "airline",
        "number",
        "departure_airport",
        "departure_time",
        "arrival_airport",
        "arrival_time",
    )
    names = classes.select(F.col("id").alias("class_id"), F.col("display_name").alias("class_name"))
    return (
        priced.join(shown, "flight_id")
        .join(names, "class_id")
        .select(
            *own,
            *PAIR,
            "class_name",
            "airline",
            "number",
            "departure_airport",
            "departure_time",
            "arrival_airport",
            "arrival_time",
            "price",
        )
    )


def cart_review(
    cart: DataFrame, flights: DataFrame, fares: DataFrame, classes: DataFrame, pair_mode: str = "exact"
) -> DataFrame:
    return fare_details(cart_fares(cart, fares, pair_mode), flights, classes)


def cart_totals(
    cart: DataFrame, fares: DataFrame, pair_mode: str = "exact", carts: DataFrame | None = None
) -> DataFrame:
    """Sum of fares per cart. NULL fares are skipped; a cart none of whose entries has a fare
    totals NULL. ``carts`` (cart_id) may list carts without entries, which total 0.00."""
    # One aggregation over the fares, a marker per entry and a marker per listed cart finds the
    # sums, the carts without fares and the carts without entries.
    rows = cart_fares(cart, fares, pair_mode).selectExpr("cart_id", "price", "true as has_entry")
    rows = rows.unionByName(cart.selectExpr("cart_id", f"cast(null as {MONEY}) as price", "true as has_entry"))
    if carts is not None:
        rows = rows.unionByName(
            carts.selectExpr("cart_id", f"cast(null as {MONEY}) as price", "false as has_entry")
        )
    return (
        rows.groupBy("cart_id")
        .agg(money(F.sum("price")).alias("total"), F.bool_or("has_entry").alias("has_entry"))
        .selectExpr("cart_id", f"if(has_entry, total, cast(0 as {MONEY})) as total")
    )


def cart_pair_audit(cart: DataFrame, fares: DataFrame) -> DataFrame:
    """Fares the ``cross`` rule puts into a cart although nobody added that pair."""
    asked = cart.select("cart_id", *PAIR).distinct()
    return _cross_pairs(cart, fares.select(*PAIR, "price")).join(asked, ["cart_id", *PAIR], "left_anti")
