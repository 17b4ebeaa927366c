"""Registered queries: every operator over the driver's whole tables.

Arrays and intervals are shown as text and minutes so that results compare across engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions.calendar import bit_positions, interval_minutes
from wayfare.functions.labels import clock_label, departure_label, flight_code, path_label
from wayfare.operators import accounts, booking, cart, changes, fares, incremental, quality, schedule, search, shared_search
from wayfare.plans import pipelines
from wayfare.session import bound_tasks, keep_dealt, stage, staging_path
from wayfare.sources import keys, tables
from wayfare.sources.manifest import Store
from wayfare.sources.schemas import schema_of
from wayfare.sources.standin import StandIn
from wayfare.streaming import accounts as account_feeds
from wayfare.streaming import bookings, feeds, keyed_carts

TODAY = "2024-01-03"

_QUERIES: dict[str, Callable[[StandIn], DataFrame]] = {}


def _query(build: Callable[[StandIn], DataFrame]) -> Callable[[StandIn], DataFrame]:
    _QUERIES[build.__name__] = build
    return build


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build):
        def query(spark: SparkSession, folder: str) -> DataFrame:
            bound_tasks(spark)
            keep_dealt(spark)
            return build(StandIn(spark, folder))

        return query

    return {name: bind(build) for name, build in _QUERIES.items()}


# -- sources ----------------------------------------------------------------


@_query
def airports(t: StandIn) -> DataFrame:
    return t.airports


@_query
def airlines(t: StandIn) -> DataFrame:
    return t.airlines


# -- timetable --------------------------------------------------------------


@_query
def bit_position_lists(t: StandIn) -> DataFrame:
    return t.schedule.select("id", F.array_join(bit_positions("days"), ",").alias("positions"))


@_query
def schedule_expand(t: StandIn) -> DataFrame:
    flights = schedule.expand_schedule(t.schedule, t.airports)
    return flights.withColumn("duration", interval_minutes("duration"))


@_query
def schedule_quarantined(t: StandIn) -> DataFrame:
    """Every line of a timetable file with broken lines in it: what became of it."""
    names = schema_of("flight_schedule").names
    fields = [F.col(c).cast("string") for c in names]
    fields[names.index("departure_min")] = F.expr("if(id % 50 = 0, 'noon', cast(departure_min as string))")
    whole = F.concat_ws(",", *[F.coalesce(f, F.lit("")) for f in fields])
    line = F.when(F.col("id") % 70 == 0, F.regexp_extract(whole, "^([^,]*,[^,]*),", 1)).otherwise(whole)
    path = _scratch(t, "timetable-file")
    t.schedule.select(line.alias("line")).write.text(path)
    rows, rejects = tables.read_quarantined(t.spark, "flight_schedule", path, header="false")
    why = F.when(F.col("broken_row").isNotNull(), "broken").otherwise(F.array_join("bad_columns", ","))
    return rows.select("id", F.lit("row").alias("outcome")).unionByName(
        rejects.select(F.col("id").cast("bigint").alias("id"), why.alias("outcome"))
    )


@_query
def timetable_build(t: StandIn) -> DataFrame:
    """The fares of the stored timetable, built from stored tables."""
    root, out = _scratch(t, "sources"), _scratch(t, "built")
    sources = {"airport": t.airports, "airline": t.airlines, "class": t.classes, "flight_schedule": t.schedule}
    for name, df in sources.items():
        df.write.parquet(f"{root}/{name}")
    built = pipelines.build_timetable(t.spark, root, out)
    return built["flight_class"].drop("departure_date")


@_query
def schedule_duration_audit(t: StandIn) -> DataFrame:
    found = schedule.duration_audit(schedule.expand_schedule(t.schedule, t.airports))
    return found.drop("id").withColumn("duration", interval_minutes("duration"))


# -- fares ------------------------------------------------------------------


@_query
def great_circle(t: StandIn) -> DataFrame:
    miles = fares.flight_miles(t.flights, t.airports)
    return miles.select("id", F.round("miles", 6).alias("miles"))


@_query
def great_circle_exact(t: StandIn) -> DataFrame:
    miles = fares.flight_miles(t.flights, t.airports, "exact")
    return miles.select("id", F.round("miles", 6).alias("miles"))


@_query
def fare_table(t: StandIn) -> DataFrame:
    return t.fares


@_query
def fare_capacity(t: StandIn) -> DataFrame:
    return t.fares.groupBy("class_id", "capacity").agg(
        F.count("*").alias("fares"), F.sum("price").cast("decimal(19,2)").alias("total")
    )


@_query
def fare_refused(t: StandIn) -> DataFrame:
    extra = t.dirty_tables["class"]
    _, refused = fares.split_fares(fares.price_flights(t.flights, t.airports, extra))
    return refused.select("flight_id", "class_id", "price")


# -- search -----------------------------------------------------------------


def _texts(itineraries: DataFrame) -> DataFrame:
    return itineraries.withColumns({"ids": F.array_join("ids", ","), "path": F.array_join("path", ",")})


def _shown(itineraries: DataFrame) -> DataFrame:
    return itineraries.select("request_id", "ids", "path", "total_legs", "total_price")


def _with_legs(t: StandIn, legs: int) -> DataFrame:
    return t.requests.withColumn("max_legs", F.lit(legs))


@_query
def search_requests(t: StandIn) -> DataFrame:
    good, _ = search.resolve_requests(t.forms, t.accounts, TODAY)
    return good.withColumn("max_wait", interval_minutes("max_wait"))


@_query
def search_requests_refused(t: StandIn) -> DataFrame:
    _, refused = search.resolve_requests(t.forms, t.accounts, TODAY)
    return refused


@_query
def search_forms(t: StandIn) -> DataFrame:
    """Forms resolved and searched in one go."""
    good, _ = search.resolve_requests(t.forms, t.accounts, TODAY)
    flights = search.within_horizon(t.flights, good)
    return _shown(search.search_itineraries(good, flights, t.fares, form=_texts))


@_query
def search_nonstop(t: StandIn) -> DataFrame:
    return _shown(search.search_itineraries(_with_legs(t, 1), t.flights, t.fares, leg_limit=1, form=_texts))


@_query
def search_one_stop(t: StandIn) -> DataFrame:
    return _shown(search.search_itineraries(_with_legs(t, 2), t.flights, t.fares, leg_limit=2, form=_texts))


@_query
def search_itineraries(t: StandIn) -> DataFrame:
    return _shown(search.search_itineraries(t.requests, t.flights, t.fares, form=_texts))


@_query
def search_stored(t: StandIn) -> DataFrame:
    """Flights and fares built, written by date, read back, pruned to the requests and searched."""
    tables.write_flights(t.flights, f"{(root := staging_path(t.spark, 'timetable'))}/flight")
    flights = tables.read_flights(t.spark, f"{root}/flight")
    tables.write_fares(fares.price_flights(flights, t.airports, t.classes), f"{root}/flight_class")
    usable = search.within_horizon(flights, t.requests, times=tables.read_flying_times(t.spark, f"{root}/flight"))
    offered = search.fares_of(tables.read_fares(t.spark, f"{root}/flight_class"), usable)
    return _shown(search.search_itineraries(t.requests, usable, offered, form=_texts))


@_query
def search_four_legs(t: StandIn) -> DataFrame:
    """Requests for one to four legs in one batch."""
    asked = t.requests.withColumn("max_legs", (1 + F.col("request_id") % 4).cast("int"))
    return _shown(search.search_itineraries(asked, t.flights, t.fares, form=_texts))


@_query
def search_reachable(t: StandIn) -> DataFrame:
    """The same itineraries, from paths that backward labels keep to what can still arrive."""
    return _shown(shared_search.search_shared(t.requests, t.flights, t.fares, form=_texts))


@_query
def search_shared(t: StandIn) -> DataFrame:
    """Every request in two classes and with two leg limits, in one walk."""
    mixed = t.requests.withColumns(
        {"class_id": F.expr("cast(1 + request_id % 4 as int)"), "max_legs": F.expr("cast(1 + request_id % 4 as int)")}
    )
    again = t.requests.withColumns(
        {"class_id": F.expr("cast(1 + (request_id + 1) % 4 as int)"), "request_id": F.expr("request_id + 1000000000")}
    )
    return _shown(shared_search.search_shared(mixed.unionByName(again), t.flights, t.fares, form=_texts))


@_query
def search_legs(t: StandIn) -> DataFrame:
    found = search.search_itineraries(t.requests, t.flights, t.fares)
    legs = search.itinerary_legs(search.deal_itineraries(found))
    return search.order_legs(legs, dealt=True).withColumns(
        {"ids": F.array_join("ids", ","), "path": F.array_join("path", ",")}
    )


@_query
def search_ranked(t: StandIn) -> DataFrame:
    ranked = search.ranked_itineraries(t.requests, t.flights, t.fares, details=False)
    return ranked.select("request_id", "rank", F.array_join("ids", ",").alias("ids"), "total_price")


@_query
def search_no_match(t: StandIn) -> DataFrame:
    trips = search.search_trips(t.requests, t.flights, t.fares, itineraries=False)
    return search.requests_without_trip(t.requests, trips).select("request_id", "origin", "destination")


@_query
def search_labels(t: StandIn) -> DataFrame:
    def labels(trips: DataFrame) -> DataFrame:
        legs = search.itinerary_legs(trips)
        return legs.select(
            *search.TRIP,
            "cell",
            "leg",
            flight_code(F.col("airline"), F.col("number")).alias("flight"),
            path_label(F.col("path")).alias("route"),
            clock_label(F.col("departure_time")).alias("departs"),
            clock_label(F.col("arrival_time")).alias("arrives"),
        )

    found = search.search_itineraries(t.requests, t.flights, t.fares, form=labels)
    return found.select("request_id", "leg", "flight", "route", "departs", "arrives")


@_query
def booking_tags(t: StandIn) -> DataFrame:
    tag = search.booking_tag(F.col("ids"), F.col("class_id"))
    found = search.search_itineraries(t.requests, t.flights, t.fares, form=lambda trips: trips.withColumn("tag", tag))
    return found.select("request_id", "tag")


@_query
def class_list(t: StandIn) -> DataFrame:
    """The classes on sale, in order, taken from the fares of the whole flight table."""
    sold = t.fares.select(F.col("class_id").alias("id")).distinct()
    return search.class_list(t.classes.join(sold, "id", "left_semi"))


# -- carts ------------------------------------------------------------------


@_query
def cart_from_tags(t: StandIn) -> DataFrame:
    rows, _ = cart.explode_tags(t.tags)
    return rows


@_query
def cart_tags_refused(t: StandIn) -> DataFrame:
    _, refused = cart.explode_tags(t.tags)
    return refused


@_query
def cart_state(t: StandIn) -> DataFrame:
    return cart.cart_state(t.cart_events)


@_query
def cart_from_many_tags(t: StandIn) -> DataFrame:
    """Carts that took several tags one after another: one cart per customer."""
    tags = t.tags.withColumns({"at": F.col("cart_id"), "cart_id": F.col("customer_id")})
    rows, _ = cart.carts_from_tags(tags, "at")
    return rows


@_query
def checkout_carts(t: StandIn) -> DataFrame:
    return cart.checked_out_carts(t.cart_events)


@_query
def checkout_tickets(t: StandIn) -> DataFrame:
    """Tickets for what the carts held at each checkout."""
    bought = cart.checked_out_carts(t.cart_events).withColumn("paid_with", F.col("customer_id"))
    tickets, _ = booking.settle(stage(booking.priced_cart(bought, t.fares), "priced-checkouts"))
    return tickets


@_query
def cart_review(t: StandIn) -> DataFrame:
    return cart.cart_review(t.cart_items, t.flights, t.fares, t.classes)


@_query
def cart_review_cross(t: StandIn) -> DataFrame:
    return cart.cart_review(t.cart_items, t.flights, t.fares, t.classes, "cross")


@_query
def cart_totals(t: StandIn) -> DataFrame:
    all_carts = t.raw("orders").select(F.col("o_orderkey").alias("cart_id"))
    return cart.cart_totals(t.cart_items, t.fares, "exact", all_carts)


@_query
def cart_totals_cross(t: StandIn) -> DataFrame:
    return cart.cart_totals(t.cart_items, t.fares, "cross")


@_query
def cart_pair_audit(t: StandIn) -> DataFrame:
    return cart.cart_pair_audit(t.cart_items, t.fares)


# -- booking ----------------------------------------------------------------


def _priced(t: StandIn) -> DataFrame:
    """The carts with their prices, staged so that they meet the fares once."""
    return stage(booking.priced_cart(t.carts, t.fares), "priced-carts")


@_query
def book_tickets(t: StandIn) -> DataFrame:
    tickets, _ = booking.settle(_priced(t))
    return tickets


@_query
def book_tickets_leg_zero(t: StandIn) -> DataFrame:
    tickets, _ = booking.settle(_priced(t), "zero")
    return tickets.drop("id")


@_query
def book_refused(t: StandIn) -> DataFrame:
    _, refused = booking.settle(_priced(t))
    return refused


@_query
def book_empty_carts(t: StandIn) -> DataFrame:
    """Tickets of carts from tags, when as many carts without an entry are checked out with them."""
    empty = t.tags.withColumns({"cart_id": F.col("cart_id") + 10**9, "tag": F.lit("[]")})
    rows, _ = cart.explode_tags(t.tags.unionByName(empty))
    tickets, _ = booking.settle(stage(booking.priced_cart(rows.withColumn("paid_with", F.col("customer_id")), t.fares), "priced-tags"))
    return tickets


@_query
def receipts_stored(t: StandIn) -> DataFrame:
    """The ticket history from tables laid out for its joins."""
    prefix, path = f"wayfare_{uuid.uuid4().hex}", _scratch(t, "bucketed")
    pipelines.save_for_joins(t.flights, t.fares, t.tickets, prefix, path)
    return pipelines.stored_receipts(t.spark, prefix, t.classes)


@_query
def ticket_history_read(t: StandIn) -> DataFrame:
    """The history of customers with an address, from tickets and links in files of other formats."""
    path = _scratch(t, "ticket-files")
    t.tickets.write.orc(f"{path}/ticket")
    t.address_links.write.option("header", "true").csv(f"{path}/customer_address")
    tickets = tables.read_table(t.spark, "ticket", f"{path}/ticket", "orc")
    links = tables.read_table(t.spark, "customer_address", f"{path}/customer_address", "csv")
    return booking.ticket_history(tickets, t.flights, t.fares, t.classes, links)


@_query
def receipts(t: StandIn) -> DataFrame:
    """Receipts of the tickets just booked."""
    tickets = stage(booking.settle(_priced(t))[0], "tickets")
    return booking.receipts(t.tickets.unionByName(tickets), t.flights, t.fares, t.classes, tickets).withColumn(
        "departing", departure_label(F.col("departure_time"))
    )


@_query
def receipt_totals(t: StandIn) -> DataFrame:
    tickets, _ = booking.settle(_priced(t))
    return booking.receipt_total(
        booking.receipts(tickets, t.flights, t.fares, t.classes), ["customer_id"]
    )


@_query
def receipt_totals_cross(t: StandIn) -> DataFrame:
    _, refused = booking.settle(_priced(t))
    booked = t.cart_items.join(refused.select("cart_id").distinct(), "cart_id", "left_anti")
    return cart.cart_totals(booked, t.fares, "cross")


@_query
def ticket_history(t: StandIn) -> DataFrame:
    return booking.ticket_history(t.tickets, t.flights, t.fares, t.classes)


# -- accounts ---------------------------------------------------------------


def _wanted_emails(t: StandIn, pattern: bool = False) -> DataFrame:
    """Every customer's address in capitals, or with its second last digit as a wildcard."""
    name = F.col("c_name")
    if pattern:
        name = F.concat(F.regexp_replace(name, "..$", "_"), F.substring(name, -1, 1))
    return t.raw("customer").select(F.concat(F.upper(name), F.lit("@EXAMPLE.COM")).alias("email"))


@_query
def customer_by_email(t: StandIn) -> DataFrame:
    return accounts.customers_by_email(_wanted_emails(t), t.accounts)


@_query
def customer_by_email_pattern(t: StandIn) -> DataFrame:
    return accounts.customers_by_email(_wanted_emails(t, pattern=True), t.accounts, "pattern")


@_query
def customer_by_email_part(t: StandIn) -> DataFrame:
    """Patterns that begin with a wildcard: one for the end of every customer's name, and one without
    three fixed characters in a row for every region."""
    ends = t.raw("customer").select(F.concat(F.lit("%"), F.substring("c_name", -5, 5), F.lit("@ex_mple%")).alias("email"))
    loose = t.raw("region").select(F.concat(F.lit("%"), F.col("r_regionkey"), F.lit("_@%")).alias("email"))
    return accounts.customers_by_email(ends.unionByName(loose), t.accounts, "pattern")


@_query
def duplicate_emails(t: StandIn) -> DataFrame:
    again = t.registrations.filter(F.col("customer_id") % 3 == 0).select("email")
    return accounts.duplicate_emails(t.registrations.select("email").unionByName(again))


@_query
def primaries(t: StandIn) -> DataFrame:
    return accounts.primaries(t.accounts)


@_query
def payment_methods(t: StandIn) -> DataFrame:
    return accounts.payment_methods(t.accounts, t.payments)


@_query
def payment_methods_read(t: StandIn) -> DataFrame:
    """The same from customers and payment methods in text files."""
    path = _scratch(t, "account-files")
    t.accounts.write.option("header", "true").csv(f"{path}/customer")
    t.payments.write.json(f"{path}/payment_method")
    customers = tables.read_table(t.spark, "customer", f"{path}/customer", "csv")
    return accounts.payment_methods(customers, tables.read_table(t.spark, "payment_method", f"{path}/payment_method", "json"))


@_query
def address_book(t: StandIn) -> DataFrame:
    return accounts.address_book(t.accounts, t.address_links, t.addresses)


@_query
def checkout_addresses(t: StandIn) -> DataFrame:
    return accounts.checkout_addresses(t.accounts, t.address_links, t.addresses)


# -- account changes --------------------------------------------------------


@_query
def apply_address_links(t: StandIn) -> DataFrame:
    return changes.apply_address_links(t.address_links, t.account_changes)


@_query
def apply_primaries(t: StandIn) -> DataFrame:
    return changes.apply_primaries(t.accounts, t.account_changes)


@_query
def allocated_keys(t: StandIn) -> DataFrame:
    """New keys for the customers of two runs of registrations, the second of which is repeated."""
    store = Store(t.spark, _scratch(t, "keys"))
    forms = t.registrations.select("customer_id", "email")
    runs = {"odd": forms.filter("customer_id % 2 = 1"), "even": forms.filter("customer_id % 2 = 0")}
    given = [keys.allocate(store, runs[run], ["customer_id"], run) for run in ("odd", "even", "even")]
    return given[0].unionByName(given[2])


@_query
def onboard_addresses(t: StandIn) -> DataFrame:
    return changes.onboard_customers(t.registrations, t.airports)[0]


@_query
def onboard_customers(t: StandIn) -> DataFrame:
    return changes.onboard_customers(t.registrations, t.airports)[1].drop("primary_payment_id")


@_query
def onboard_links(t: StandIn) -> DataFrame:
    return changes.onboard_customers(t.registrations, t.airports)[2]


@_query
def onboard_refused(t: StandIn) -> DataFrame:
    return changes.onboard_customers(t.registrations, t.airports)[3]


@_query
def add_addresses(t: StandIn) -> DataFrame:
    return changes.add_addresses(t.address_forms)[0]


@_query
def add_address_links(t: StandIn) -> DataFrame:
    return t.address_links.unionByName(changes.add_addresses(t.address_forms)[1])


@_query
def add_payments(t: StandIn) -> DataFrame:
    return changes.add_payments(t.payment_forms)[0]


@_query
def add_payments_refused(t: StandIn) -> DataFrame:
    return changes.add_payments(t.payment_forms)[1]


@_query
def remove_payments(t: StandIn) -> DataFrame:
    return changes.remove_payments(t.payments, t.payment_removals)


@_query
def apply_changes_address(t: StandIn) -> DataFrame:
    return changes.apply_addresses(t.addresses, t.change_log)


@_query
def apply_changes_customer_address(t: StandIn) -> DataFrame:
    return changes.apply_address_links(t.address_links, t.change_log)


@_query
def apply_changes_payment_method(t: StandIn) -> DataFrame:
    return changes.apply_payments(t.payments, t.change_log)[0]


# -- integrity --------------------------------------------------------------


@_query
def integrity_pk(t: StandIn) -> DataFrame:
    return quality.primary_key_report(t.dirty_tables)


@_query
def integrity_nulls(t: StandIn) -> DataFrame:
    return quality.not_null_report(t.dirty_tables)


@_query
def integrity_fk(t: StandIn) -> DataFrame:
    return quality.foreign_key_report(t.dirty_tables)


@_query
def integrity_domain(t: StandIn) -> DataFrame:
    return quality.domain_report(t.dirty_tables)


@_query
def integrity_incremental(t: StandIn) -> DataFrame:
    """Keys and references of account tables that were appended in parts, each part checked by itself."""
    found = t.dirty_tables
    known = incremental.Known.nothing(t.spark)
    part = F.pmod(F.xxhash64("email"), F.lit(3))
    parts = [found["customer"].filter(part == n) for n in range(3)]
    for table, rows in [
        ("customer", parts[0]),
        ("payment_method", found["payment_method"]),
        ("customer", parts[1]),
        ("address", found["address"]),
        ("customer", parts[2]),
    ]:
        after = incremental.add_partition(known, table, rows)
        known = incremental.Known(*[stage(df, "known") for df in (after.keys, after.repeated, after.orphans)])
    return incremental.report(known)


# -- streams ----------------------------------------------------------------


def _scratch(t: StandIn, label: str) -> str:
    return staging_path(t.spark, label)


def _as_stream(t: StandIn, df: DataFrame, label: str, files: int = 4) -> DataFrame:
    """Put a table into a few files and read them as a stream, one file per micro-batch."""
    path = _scratch(t, label)
    df.repartition(files).write.parquet(path)
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@_query
def cart_stream(t: StandIn) -> DataFrame:
    """Carts after the events ran as a stream in shuffled order, from a log rewritten on the way."""
    events = t.cart_events.drop("ts")
    log = _scratch(t, "cart-log")
    feeds.start_cart_log(_as_stream(t, events, "cart-events"), log, _scratch(t, "cart-log-state")).awaitTermination()
    feeds.rewrite_cart_log(t.spark, log, leave=1)
    reduced = feeds.read_log(t.spark, log, cart.reduce_cart_events(events).schema)
    return cart.cart_state(reduced)


@_query
def cart_keyed_stream(t: StandIn) -> DataFrame:
    """The same carts from keyed state, by the changes it put out."""
    keyed_carts.use_rocksdb(t.spark)
    # The files come in any order, so an event may be as late as the whole log is long.
    stream = _as_stream(t, t.cart_events, "cart-events", files=2)
    out = keyed_carts.cart_changes(stream, shards=2, late="3650 days")
    log, checkpoint = _scratch(t, "cart-changes"), _scratch(t, "cart-changes-state")
    feeds.start_log(out, log, checkpoint).awaitTermination()
    return keyed_carts.current_carts(feeds.read_log(t.spark, log, out.schema))


@_query
def booking_stream(t: StandIn) -> DataFrame:
    """Tickets after all booking tags were checked out as a stream."""
    checkouts = t.tags.withColumn("paid_with", F.col("customer_id"))
    # Every third checkout is sent twice, in the same micro-batch or in another.
    checkouts = checkouts.unionByName(checkouts.filter("cart_id % 3 = 0"))
    booked = _scratch(t, "bookings")
    bookings.start_bookings(
        _as_stream(t, checkouts, "checkouts"), stage(t.fares, "fares"), booked, _scratch(t, "booking-state")
    ).awaitTermination()
    return tables.read_tickets(t.spark, booked)


@_query
def ticket_append(t: StandIn) -> DataFrame:
    """Tickets of two runs, the second one repeated and the first killed once before it was committed."""
    path = _scratch(t, "ticket-store")
    tickets, _ = booking.settle(_priced(t))
    tickets = stage(tickets, "tickets")
    halves = [tickets.filter("customer_id % 2 = 0"), tickets.filter("customer_id % 2 <> 0")]
    Store(t.spark, path).write(halves[0], "ticket")
    for half, run in ((0, "even"), (1, "odd"), (1, "odd")):
        tables.append_tickets(halves[half], path, run)
    bookings.compact_tickets(t.spark, path)
    return tables.read_tickets(t.spark, path)


def _streamed_accounts(t: StandIn, log: DataFrame, table: str, base: DataFrame) -> DataFrame:
    """A table after a log ran as a stream in shuffled order, merged half-way and again at the end, all twice."""
    path = _scratch(t, "account-store")
    account_feeds.start_store(t.spark, path, {table: base})
    for part in range(2):
        stream = _as_stream(t, log.filter(f"pmod(xxhash64(seq), 2) = {part}"), "account-changes", files=2)
        for _ in range(2):  # from two checkpoints: every batch comes twice
            feeds.start_account_log(stream, path, _scratch(t, "account-log-state")).awaitTermination()
        account_feeds.merge_log(t.spark, path, log.schema)
        account_feeds.merge_log(t.spark, path, log.schema)
    return account_feeds.read_accounts(t.spark, path, log.schema)[table]


@_query
def account_stream(t: StandIn) -> DataFrame:
    """Customers after the account changes ran as a stream."""
    return _streamed_accounts(t, t.account_changes, "customer", t.accounts)


@_query
def account_stream_address(t: StandIn) -> DataFrame:
    return _streamed_accounts(t, t.change_log, "address", t.addresses)


@_query
def account_stream_customer_address(t: StandIn) -> DataFrame:
    return _streamed_accounts(t, t.change_log, "customer_address", t.address_links)


@_query
def account_stream_payment_method(t: StandIn) -> DataFrame:
    return _streamed_accounts(t, t.change_log, "payment_method", t.payments)
