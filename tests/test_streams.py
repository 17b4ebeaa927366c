import datetime as dt
import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import tuples
from tests.test_accounts_quality import FULL_LOG, account_log, account_tables, check_account_tables
from tests.test_accounts_quality import customers  # noqa: F401
from tests.test_cart_booking import fares, plain_fold  # noqa: F401
from wayfare.functions import bitmaps
from wayfare.operators import snapshots
from wayfare.operators.cart import cart_state, reduce_cart_events
from wayfare.operators.changes import apply_changes
from wayfare.session import stage
from wayfare.sources import tables
from wayfare.sources.manifest import Store
from wayfare.streaming import accounts, bookings, feeds, keyed_carts

EVENT = "seq bigint, customer_id bigint, action string, flight_id bigint, class_id int"
ENTRY = ["customer_id", "seq", "flight_id", "class_id"]

# Late: the clear of customer 1 arrives before an older add, the removal before its add.
BATCHES = [
    [(1, 1, "add", 5, 1), (9, 1, "clear", None, None), (2, 2, "add", 6, 1), (12, 1, "add", 5, 1)],
    [(3, 1, "add", 7, 1), (8, 2, "remove", 6, 1), (20, 2, "remove", 8, 2), (10, 2, "add", 6, 1)],
    [(11, 2, "add", 8, 2), (13, 3, "add", 1, 1), (14, 3, "checkout", None, None), (12, 1, "add", 5, 1)],
]
ALL = sorted(set(sum(BATCHES, [])))


def land(spark, batches, schema, path):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_cart_log_equals_the_batch_fold(spark, tmp_path):
    stream, log_path = land(spark, BATCHES, EVENT, tmp_path), f"{tmp_path}/log"
    for _ in range(2):
        feeds.start_cart_log(stream, log_path, f"{tmp_path}/cp").awaitTermination()
    schema = reduce_cart_events(spark.createDataFrame([], EVENT)).schema
    log = feeds.read_log(spark, log_path, schema)
    assert tuples(cart_state(log), *ENTRY) == plain_fold(ALL) == [(1, 12, 5, 1), (2, 10, 6, 1)]
    assert feeds.compact_cart_log(log, settled_seq=100).count() == 2
    # Rewritten in parts, with events still to come.
    feeds.rewrite_cart_log(spark, log_path, leave=1)
    assert len(Store(spark, log_path).latest().tables[feeds.LOG]) == 2
    short = feeds.read_log(spark, log_path, schema)
    assert tuples(cart_state(short), *ENTRY) == plain_fold(ALL) and short.count() < log.count()
    late = [(4, 1, "add", 7, 1), (30, 2, "clear", None, None)]
    spark.createDataFrame(late, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    feeds.start_cart_log(stream, log_path, f"{tmp_path}/cp").awaitTermination()
    feeds.rewrite_cart_log(spark, log_path, settled_seq=30)
    assert tuples(cart_state(feeds.read_log(spark, log_path, schema)), *ENTRY) == plain_fold(ALL + late) == [(1, 12, 5, 1)]


def test_keyed_carts_equal_the_batch_fold(spark, tmp_path):
    keyed_carts.use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        out = keyed_carts.cart_changes(land(spark, BATCHES, EVENT, tmp_path), shards=2)
        feeds.start_log(out, f"{tmp_path}/log", f"{tmp_path}/cp").awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    changes = feeds.read_log(spark, f"{tmp_path}/log", out.schema)
    assert tuples(keyed_carts.current_carts(changes), *ENTRY) == plain_fold(ALL)
    assert changes.filter("not in_cart").count() > 0


class CountingState:
    """A shard's state in plain Python, counting the messages that a real one would send."""

    def __init__(self):
        self.value, self.rows, self.timers, self.calls = None, {}, [], 0

    def getValueState(self, name, schema):
        return SimpleNamespace(get=lambda: self.call(self.value), exists=lambda: self.call(self.value is not None), update=self.update, clear=lambda: self.update(None))

    def getMapState(self, name, key, value):
        return SimpleNamespace(
            getValue=lambda k: self.call(self.rows.get(k)),
            containsKey=lambda k: self.call(k in self.rows),
            updateValue=lambda k, v: self.call(self.rows.update({k: v})),
            removeKey=lambda k: self.call(self.rows.pop(k, None)),
            iterator=lambda: self.call(iter(list(self.rows.items()))),
        )

    def update(self, value):
        self.call(None)
        self.value = value

    def registerTimer(self, due):
        self.call(self.timers.append(due))

    def call(self, result):
        self.calls += 1
        return result


def test_a_keyed_cart_asks_its_state_once_a_pair():
    state, shard = CountingState(), keyed_carts.CartShard(True)
    shard.init(state)
    start = pd.Timestamp("2024-01-01")
    rows = [(n, "add", n, 1, start + pd.Timedelta(minutes=n)) for n in range(4)]
    rows += [(n + 4, "remove", n, 1, start + pd.Timedelta(minutes=n + 4)) for n in range(3)]
    events = pd.DataFrame([*rows, (9, "clear", None, None, start)], columns=["seq", "action", "flight_id", "class_id", "ts"])
    assert not any(len(out) for out in shard.handleInputRows((7, 0), iter([events]), None))
    # The clear is read and written, the pairs listed, three marks written and one timer set.
    assert state.calls <= 7 and len(state.timers) == 1

    # What can go does so when the watermark has passed it, and the next timer is set for the rest.
    watermark = SimpleNamespace(getCurrentWatermarkInMs=lambda: int((start + pd.Timedelta(minutes=5)).timestamp() * 1000))
    expired = SimpleNamespace(getExpiryTimeInMs=lambda: state.timers[0])
    list(shard.handleExpiredTimer((7, 0), watermark, expired))
    assert state.value is None and list(state.rows) == [(2, 1)]
    assert state.timers[-1] == int((start + pd.Timedelta(minutes=6)).timestamp() * 1000)


def timed_events(batches):
    """Rounds of a shop: every customer adds two pairs, takes one out again and pays, later ones in later batches."""
    start, out, seq = dt.datetime(2024, 1, 1), [], 0
    for n in range(batches):
        rows = []
        for customer in (n, n + 1000):
            for action, flight in (("add", 1), ("add", 2), ("remove", 2), ("checkout", None)):
                seq += 1
                rows.append((seq, customer, action, flight, 1 if flight else None, start + dt.timedelta(minutes=10 * n, seconds=seq % 60)))
        out.append(rows)
    return out


def test_keyed_state_stays_flat_and_equals_the_batch(spark, tmp_path):
    """The customers of a batch are new and pay at its end: what is left of them goes by timers."""
    keyed_carts.use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    batches = timed_events(50)
    # An addition that is later than the watermark allows, after its removal was forgotten.
    batches[-1].append((2, 0, "add", 2, 1, dt.datetime(2024, 1, 1)))
    batches[-1].append((10_000, 7777, "add", 5, 2, dt.datetime(2024, 1, 1, 8, 10)))
    schema = f"{EVENT}, ts timestamp"
    try:
        out = keyed_carts.cart_changes(land(spark, batches, schema, tmp_path), shards=2, late="20 minutes")
        query = feeds.start_log(out, f"{tmp_path}/log", f"{tmp_path}/cp")
        query.awaitTermination()
        sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(sizes) >= 50
    assert max(sizes[25:49]) <= max(sizes[5:25]) < 40  # three or so batches' worth, not fifty
    changes = feeds.read_log(spark, f"{tmp_path}/log", out.schema)
    events = [r[:5] for batch in batches for r in batch if r[0] != 2 or r[1] != 0 or r[5] != dt.datetime(2024, 1, 1)]
    assert tuples(keyed_carts.current_carts(changes), *ENTRY) == plain_fold(events) == [(7777, 10_000, 5, 2)]


def booked_pairs(spark, path):
    return tuples(tables.read_tickets(spark, path), "flight", "class_id", "customer_id")


def test_bookings_are_whole_and_not_repeated(spark, fares, tmp_path):  # noqa: F811
    def ts(minute):
        return dt.datetime(2024, 1, 1, 0, minute)

    schema = "ts timestamp, cart_id bigint, customer_id bigint, paid_with bigint, tag string"
    batches = [
        [(ts(1), 1, 7, 900, "[[1, 1], [2, 2]]"), (ts(2), 2, 7, 900, "[[1, 1], [3, 2]]")],
        [(ts(3), 1, 7, 900, "[[1, 1], [2, 2]]"), (ts(4), 3, 8, None, "[[1, 1]]"), (ts(5), 4, 8, 1, "?")],
    ]
    path = f"{tmp_path}/booked"
    bookings.start_bookings(
        land(spark, batches, schema, tmp_path), fares, path, f"{tmp_path}/cp", late="1 hour"
    ).awaitTermination()
    assert booked_pairs(spark, path) == [(1, 1, 7), (2, 2, 7)]
    assert tuples(bookings.read_refused(spark, path), "cart_id", "reason") == [
        (2, "no price"), (2, None), (3, "no payment method"), (4, "unreadable tag"),
    ]


CHECKOUT = "cart_id bigint, customer_id bigint, paid_with bigint, tag string"


def test_a_checkout_sent_again_is_booked_once_without_a_watermark(spark, fares, tmp_path):  # noqa: F811
    one, two = (1, 7, 900, "[[1, 1], [2, 2]]"), (2, 8, 900, "[[1, 1]]")
    batches = [[one, one], [two, one], [one], [two]]
    path = f"{tmp_path}/booked"
    stream = land(spark, batches, CHECKOUT, tmp_path)
    for checkpoint in ("cp", "cp", "other"):  # the last one reads everything again
        bookings.start_bookings(stream, fares, path, f"{tmp_path}/{checkpoint}").awaitTermination()
    assert booked_pairs(spark, path) == [(1, 1, 7), (1, 1, 8), (2, 2, 7)]


def test_a_batch_is_staged_once_and_its_index_comes_from_the_written_tickets(spark, fares, tmp_path, monkeypatch):  # noqa: F811
    labels, read = [], []
    monkeypatch.setattr(bookings, "stage", lambda df, label: labels.append(label) or stage(df, label))
    plain = Store.read_folders
    monkeypatch.setattr(Store, "read_folders", lambda self, folders, schema: read.extend(folders) or plain(self, folders, schema))
    store = Store(spark, f"{tmp_path}/booked")
    batch = spark.createDataFrame([(1, 7, 5, "[[1, 1]]"), (2, 8, 6, "none")], "cart_id bigint, customer_id bigint, paid_with bigint, tag string")
    for number in range(2):  # the second batch finds its cart booked
        bookings.book_batch(store, batch, fares, number)
    assert labels == ["fresh-checkouts", "priced-checkouts"] * 2
    assert sum(f.startswith("ticket-") for f in read) == 2
    assert tables.read_tickets(spark, f"{tmp_path}/booked").count() == 1


def test_a_batch_reads_the_ranges_it_touches_whatever_was_booked(spark, fares, tmp_path, monkeypatch):  # noqa: F811
    store = Store(spark, f"{tmp_path}/booked")
    read, plain, plain_price = [], store.read_folders, bookings.priced_cart
    monkeypatch.setattr(store, "read_folders", lambda folders, schema: read.append(list(folders)) or plain(folders, schema))
    monkeypatch.setattr(bookings, "priced_cart", lambda cart, fares: plain_price(cart, fares).coalesce(1))
    far = 1 << 30  # in a range of its own
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    for n in range(30):
        rows = [(1 + n, 7, 900, "[[1, 1]]"), (far + n * 40_000, 8, 900, "[[1, 1]]"), (1 + n // 2, 7, 900, "[[1, 1]]")]
        batch = spark.createDataFrame(rows, CHECKOUT).coalesce(1)
        bookings.book_batch(store, batch, fares, n)
        if n % 10 == 0:  # retried
            bookings.book_batch(store, batch, fares, n)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert all(len(folders) <= 2 for folders in read)
    index = [f for t, fs in store.latest().tables.items() if t.startswith("booked-") for f in fs]
    files = plain(index, bitmaps.SCHEMA).inputFiles()
    assert len(index) == 2 and len(files) == 2
    tickets = tables.read_tickets(spark, store.path)
    assert tickets.count() == 60 and tickets.select("id").distinct().count() == 60
    bookings.compact_tickets(spark, store.path, leave=2)
    assert len(store.latest().tables["ticket"]) == 3
    assert tables.read_tickets(spark, store.path).count() == 60


def test_bits_tell_booked_carts(spark):
    ids = [1, 2, 8, 9, 32_768, 32_769, 65_536, 1_000_000_007, 0]
    carts = spark.createDataFrame([(i,) for i in [*range(66_000), 1_000_000_007, 1_000_000_008, None]], "cart_id bigint")
    bits = bitmaps.bitmaps(spark.createDataFrame([(i,) for i in [*ids, None]], "cart_id bigint"), "cart_id")
    told = bitmaps.marked(carts, "cart_id", bits, "booked")
    assert told.count() == 66_003
    assert [r[0] for r in tuples(told.where("booked"), "cart_id")] == sorted(ids)


def test_account_stream_equals_the_batch(spark, make, customers, tmp_path):  # noqa: F811
    """With merges after any batch, batches that come again, and a merge that finds nothing."""
    schema = account_log(spark).schema
    rows = [tuple(r) for r in account_log(spark).collect()]
    path, base = f"{tmp_path}/store", account_tables(make, customers)
    for _ in range(2):
        accounts.start_store(spark, path, base)
    for n, batch in enumerate([rows[5:], rows[:3], rows[3:5], rows[:1]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        feeds.start_account_log(stream, path, f"{tmp_path}/cp").awaitTermination()
        if n in (0, 2):
            for _ in range(2):
                accounts.merge_log(spark, path, schema)
            assert Store(spark, path).latest().tables[feeds.LOG] == []
    check_account_tables(accounts.read_accounts(spark, path, schema))
    accounts.merge_log(spark, path, schema)
    check_account_tables(accounts.read_accounts(spark, path, schema))


@pytest.mark.parametrize("seed", range(2))
def test_snapshots_merged_in_any_order_equal_the_whole_log(spark, make, customers, seed):  # noqa: F811
    rng = random.Random(seed)
    blank = (None,) * 11

    def form(month):
        return ("1 St", None, "C", "P", "9", "L", "4999222233334444", "2030", month, "H", 10)

    rows = []
    for seq in range(100, 160):
        action = rng.choice(["add_address", "remove_address", "add_payment", "remove_payment", "set_primary_address", "set_primary_payment"])
        details = form(rng.choice(["8", "13", "x"])) if action.startswith("add") else blank
        rows.append((seq, rng.randint(1, 3), action, rng.randint(5, 12), *details))
    schema, tables_ = account_log(spark).schema, account_tables(make, customers)
    whole = apply_changes(tables_, spark.createDataFrame(rows, schema))
    rng.shuffle(rows)
    now = snapshots.first_snapshot(tables_) | {"refused_payment": spark.createDataFrame([], snapshots.REFUSED)}
    for part in (rows[:25], rows[20:40], rows[40:], rows[:10]):
        now = {t: stage(df, t) for t, df in snapshots.merge(now, spark.createDataFrame(part, schema)).items()}
    for table, df in snapshots.current(now).items():
        assert tuples(df, *whole[table].columns) == tuples(whole[table], *whole[table].columns), table
    settled = snapshots.merge(now, spark.createDataFrame([], schema), settled_seq=1000)
    assert settled["customer_address"].where("gone").count() == 0
    assert settled["payment_method"].count() == whole["payment_method"].count()
