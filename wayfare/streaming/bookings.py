"""Bookings as a stream into one store.

A store holds the tables ``ticket`` and ``refused`` and an index of the carts that are booked. The index has
one bit per cart, in bitmaps of fixed size, and one folder per range of cart ids; a micro-batch reads the
ranges of its own carts and writes them anew with its bookings. Tickets, refusals and index become visible
together, under the batch's number. So a batch costs the same whatever was booked before it, and a cart that
is sent again, in its own batch, a retried one or a later one, is booked once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayfare.functions import bitmaps
from wayfare.operators.booking import POSITION_BITS, priced_cart, settle
from wayfare.operators.cart import explode_tags
from wayfare.session import stage
from wayfare.sources.manifest import Conflict, Store, Version
from wayfare.sources.schemas import schema_of

WRITER = "bookings"
REFUSED = "cart_id bigint, customer_id bigint, seq bigint, flight_id bigint, class_id int, reason string"
#: Bitmaps of a range as a power of two.
RANGE_BITS = 10


def _range(bucket: str) -> str:
    return f"shiftright({bucket}, {RANGE_BITS})"


def _index(number: int) -> str:
    return f"booked-{number}"


def book_batch(store: Store, batch: DataFrame, fares: DataFrame, number: int, writer: str = WRITER) -> Version:
    """Book checkouts (cart_id, customer_id, paid_with, tag) as batch ``number`` of a store.

    A cart that comes twice counts once. Does nothing if the batch was committed before.
    """
    before = store.latest()
    if before.has(writer, number):
        return before
    once = batch.groupBy("cart_id").agg(F.min(F.struct("tag", "customer_id", "paid_with")).alias("x"))
    once = once.select("cart_id", "x.customer_id", "x.paid_with", "x.tag")
    # As many as ranges of ids, not as carts.
    touched = [r["r"] for r in batch.select(F.expr(_range(bitmaps.bucket("cart_id"))).alias("r")).distinct().collect()]
    held = store.read_folders([f for r in touched for f in before.tables.get(_index(r), [])], bitmaps.SCHEMA)

    # Staged, since both the carts and the broken tags come from them, and the carts once more when
    # priced, since all outputs read those.
    fresh = stage(bitmaps.marked(once, "cart_id", held, "booked").where("not booked").drop("booked"), "fresh-checkouts")
    cart, broken = explode_tags(fresh)
    tickets, refused = settle(stage(priced_cart(cart, fares), "priced-checkouts"))
    unreadable = broken.selectExpr(
        "cart_id",
        "customer_id",
        "cast(null as bigint) as seq",
        "cast(null as bigint) as flight_id",
        "cast(null as int) as class_id",
        "'unreadable tag' as reason",
    )
    folders = {
        "ticket": store.write(tickets, "ticket"),
        "refused": store.write(refused.unionByName(unreadable), "refused"),
    }
    written = store.read_folders([folders["ticket"]], tickets.schema)
    booked = bitmaps.bitmaps(written, f"shiftright(id, {POSITION_BITS})")
    index = bitmaps.merged(held.unionByName(booked))
    name = store.write_by(index.withColumn("range", F.expr(_range("bucket"))), "booked", "range")
    while True:
        tables = {t: [*before.tables.get(t, []), f] for t, f in folders.items()}
        tables |= {_index(r): [f"{name}/range={r}"] for r in touched if store.has_folder(f"{name}/range={r}")}
        try:
            return store.commit(before, tables, {writer: number})
        except Conflict:  # with a compaction; only one stream books into a store
            before = store.latest()
            if before.has(writer, number):
                return before


def start_bookings(
    checkouts: DataFrame,
    fares: DataFrame,
    path: str,
    checkpoint: str,
    late: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Book a stream of checkouts (cart_id, customer_id, paid_with, tag) against stored fares.

    A checkout is one row, so all its items are in one micro-batch and it is booked as a whole. With
    ``late`` (such as "1 hour") the stream needs a ``ts`` column, and a checkout sent again within that
    time is dropped before it meets the index.
    """
    if late is not None:
        checkouts = checkouts.withWatermark("ts", late).dropDuplicatesWithinWatermark(["cart_id"])
    store = Store(checkouts.sparkSession, path)

    def land(batch: DataFrame, number: int) -> None:
        book_batch(store, batch, fares, number, f"{WRITER}@{checkpoint}")

    return (
        checkouts.writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_refused(spark: SparkSession, path: str) -> DataFrame:
    return Store(spark, path).read("refused", REFUSED)


def compact_tickets(spark: SparkSession, path: str, leave: int = 0) -> Version:
    """Rewrite the tickets of all batches but the newest ``leave`` as one folder."""
    return Store(spark, path).compact("ticket", schema_of("ticket"), leave)
