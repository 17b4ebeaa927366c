import json
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import at, usd
from tests.helpers import ordered, tuples
from wayfare.operators import booking, cart
from wayfare.sources.tables import cabin_classes

CART = "cart_id bigint, customer_id bigint, seq bigint, flight_id bigint, class_id int, paid_with bigint"
EVENT = "seq bigint, customer_id bigint, action string, flight_id bigint, class_id int"


def carts(spark, *rows):
    return spark.createDataFrame([(*r, 900) if len(r) == 5 else r for r in rows], CART)


@pytest.fixture
def fares(make):
    prices = {(f, c): usd(f"{f}0{c}.00") for f in (1, 2, 3) for c in (1, 2)}
    prices[3, 2] = None
    return make("flight_class", [{"flight_id": f, "class_id": c, "price": p} for (f, c), p in prices.items()])


@pytest.fixture
def flights(make):
    return make(
        "flight",
        [{"id": i, "airline": "XX", "number": i, "departure_time": at("2024-01-01 08:00")} for i in (1, 2, 3)],
    )


def events(spark, *rows):
    return spark.createDataFrame(rows, EVENT)


def state(spark, *rows):
    return tuples(cart.cart_state(events(spark, *rows)), "customer_id", "seq", "flight_id", "class_id")


# -- fold --------------------------------------------------------------------


def test_remove_takes_all_equal_pairs_and_later_adds_stay(spark):
    log = [(1, 5, "add", 1, 1), (2, 5, "add", 1, 1), (3, 5, "add", 1, 2), (4, 5, "remove", 1, 1), (5, 5, "add", 1, 1)]
    assert state(spark, *log) == [(5, 3, 1, 2), (5, 5, 1, 1)]
    assert state(spark, *reversed(log)) == state(spark, *log)


def test_clear_and_checkout_empty_only_that_customer(spark):
    log = [
        (1, 5, "add", 1, 1), (2, 6, "add", 1, 1), (3, 5, "clear", None, None), (4, 5, "add", 2, 1),
        (5, 6, "checkout", None, None), (6, 7, "add", 3, 1),
    ]
    assert state(spark, *log) == [(5, 4, 2, 1), (7, 6, 3, 1)]


def test_duplicates_are_kept(spark):
    assert len(state(spark, (1, 5, "add", 1, 1), (2, 5, "add", 1, 1))) == 2


def plain_fold(log):
    kept = {}
    for seq, who, action, flight, cabin in sorted(log):
        mine = kept.setdefault(who, [])
        if action == "add":
            mine.append((who, seq, flight, cabin))
        elif action == "remove":
            kept[who] = [e for e in mine if e[2:] != (flight, cabin)]
        else:
            kept[who] = []
    return ordered(e for mine in kept.values() for e in mine)


def test_fold_equals_replaying_the_events(spark):
    import random

    rng = random.Random(5)
    kinds = ["add"] * 8 + ["remove"] * 3 + ["clear", "checkout"]
    # One customer makes two thirds of the events.
    log = [
        (i, rng.choice([1, 1, 1, 1, 2, 3]), rng.choice(kinds), rng.randrange(4), rng.randrange(2)) for i in range(600)
    ]
    rng.shuffle(log)
    assert state(spark, *log) == plain_fold(log)
    reduced = cart.reduce_cart_events(events(spark, *log))
    assert tuples(cart.cart_state(reduced), "customer_id", "seq", "flight_id", "class_id") == plain_fold(log)
    assert reduced.count() < 600


# -- tags --------------------------------------------------------------------


def test_tags(spark):
    tags = spark.createDataFrame(
        [
            (1, 10, "[[5, 1], [6, 1]]"),
            (2, 10, '[[5, "2"]]'),
            (3, 10, "[[5]]"),
            (4, 10, "nonsense"),
            (5, 10, None),
            (6, 10, '[[5, "x"]]'),
            (7, 10, "[]"),
            (8, 10, "[[1, 2, 3]]"),
        ],
        "cart_id bigint, customer_id bigint, tag string",
    )
    rows, refused = cart.explode_tags(tags)
    assert tuples(rows, "cart_id", "seq", "flight_id", "class_id") == [(1, 1, 5, 1), (1, 2, 6, 1), (2, 1, 5, 2)]
    assert tuples(refused, "cart_id") == [(3,), (4,), (5,), (6,), (8,)]


# -- review and totals -------------------------------------------------------


def test_pair_modes(spark, fares):
    two = carts(spark, (1, 7, 1, 1, 1), (1, 7, 2, 2, 2), (1, 7, 3, 2, 2))
    exact = cart.cart_fares(two, fares)
    cross = cart.cart_fares(two, fares, "cross")
    assert tuples(exact, "flight_id", "class_id") == [(1, 1), (2, 2), (2, 2)]
    assert tuples(cross, "flight_id", "class_id") == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert tuples(cart.cart_pair_audit(two, fares), "cart_id", "flight_id", "class_id") == [(1, 1, 2), (1, 2, 1)]
    assert tuples(cart.cart_totals(two, fares), "total") == [(usd("505.00"),)]
    assert tuples(cart.cart_totals(two, fares, "cross"), "total") == [(usd("606.00"),)]
    with pytest.raises(ValueError):
        cart.cart_fares(two, fares, "other")


def test_totals_of_empty_and_unpriced_carts(spark, fares):
    some = carts(spark, (1, 7, 1, 99, 1), (2, 7, 1, 3, 1), (2, 7, 2, 3, 2))
    listed = spark.createDataFrame([(i,) for i in (1, 2, 3)], "cart_id bigint")
    totals = cart.cart_totals(some, fares, "exact", listed)
    assert tuples(totals, "cart_id", "total") == [(1, None), (2, usd("301.00")), (3, usd("0.00"))]


def test_review_shows_details(spark, fares, flights):
    out = cart.cart_review(carts(spark, (1, 7, 1, 1, 2)), flights, fares, cabin_classes(spark))
    assert tuples(out, "cart_id", "class_name", "airline", "number", "price") == [
        (1, "Economy Comfort", "XX", 1, usd("102.00"))
    ]


# -- checkouts ---------------------------------------------------------------

EVENTS = "seq bigint, customer_id bigint, action string, flight_id bigint, class_id int, tag string"


def plain_checkouts(events):
    """What each checkout buys, by replaying the events."""
    held, out = {}, []
    for seq, customer, action, flight, cabin, tag in sorted(set(events)):
        mine = held.setdefault(customer, [])
        if action == "add":
            mine.append((flight, cabin))
        elif action == "add_group":
            mine += [tuple(map(int, pair)) for pair in json.loads(tag)]
        elif action == "remove":
            held[customer] = [p for p in mine if p != (flight, cabin)]
        else:
            if action == "checkout":
                out += [(seq, customer, i, *p) for i, p in enumerate(mine, 1)]
            held[customer] = []
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_checkouts_buy_what_the_cart_holds(spark, monkeypatch, seed):
    monkeypatch.setattr(cart, "SLICE", 7)  # most rows look beyond their slice
    rng = random.Random(seed)
    actions = ["add"] * 5 + ["add_group", "remove", "remove", "clear", "checkout"]
    events = []
    for seq in range(1, 160):
        action = rng.choice(actions)
        pair = (rng.randrange(4), 1) if action in ("add", "remove") else (None, None)
        tag = f"[[{rng.randrange(4)}, 1], [{rng.randrange(4)}, 1]]" if action == "add_group" else None
        events.append((seq, rng.choice([1, 1, 1, 2, 3]), action, *pair, tag))
    again = events + rng.sample(events, 40)
    rng.shuffle(again)
    got = cart.checked_out_carts(spark.createDataFrame(again, EVENTS))
    assert tuples(got, "cart_id", "customer_id", "seq", "flight_id", "class_id") == plain_checkouts(events)


def test_tags_of_one_cart_are_numbered_through(spark):
    tags = spark.createDataFrame(
        [(1, 20, "[[5, 1]]"), (1, 10, "[[7, 1], [8, 2]]"), (2, 1, "?")], "cart_id bigint, at int, tag string"
    )
    rows, refused = cart.carts_from_tags(tags, "at")
    assert tuples(rows, "cart_id", "seq", "flight_id", "class_id") == [(1, 1, 7, 1), (1, 2, 8, 2), (1, 3, 5, 1)]
    assert tuples(refused, "cart_id") == [(2,)]


# -- booking -----------------------------------------------------------------


def test_carts_are_booked_whole_or_not_at_all(spark, fares):
    asked = carts(
        spark,
        (1, 7, 1, 1, 1),
        (1, 7, 2, 2, 1),
        (2, 7, 1, 1, 1),
        (2, 7, 2, 99, 1),
        (3, 7, 1, 3, 2),
        (4, 8, 1, 2, 1, None),
    )
    tickets, refused = booking.book_tickets(asked, fares)
    assert tuples(tickets, "price", "leg", "flight", "customer_id", "paid_with", "class_id") == [
        (usd("101.00"), 1, 1, 7, 900, 1),
        (usd("201.00"), 2, 2, 7, 900, 1),
    ]
    assert tuples(refused, "cart_id", "seq", "reason") == [
        (2, 1, None), (2, 2, "no price"), (3, 1, "no price"), (4, 1, "no payment method"),
    ]


def test_leg_zero_and_empty_cart(spark, fares):
    tickets, _ = booking.book_tickets(carts(spark, (1, 7, 1, 1, 1), (1, 7, 2, 2, 1)), fares, "zero")
    assert tuples(tickets, "leg") == [(0,), (0,)]
    tickets, refused = booking.book_tickets(carts(spark), fares)
    assert tickets.count() == refused.count() == 0


def test_ticket_ids_are_distinct_repeatable_and_checked(spark, fares):
    asked = carts(spark, *[(c, 7, s, 1, 1) for c in range(20) for s in range(1, 9)])
    tickets, _ = booking.book_tickets(asked, fares)
    again, _ = booking.book_tickets(asked.repartition(5), fares)
    assert tickets.select("id").distinct().count() == 160
    assert tuples(tickets, "id") == tuples(again, "id")
    with pytest.raises(Exception, match="too large"):
        booking.book_tickets(carts(spark, (1, 7, 2**20, 1, 1)), fares)[0].collect()


def test_receipts_show_the_current_fare(spark, make, fares, flights):
    tickets = make(
        "ticket",
        [
            {"id": 1, "price": usd("5.00"), "flight": 1, "customer_id": 7, "class_id": 1},
            {"id": 2, "price": usd("5.00"), "flight": 2, "customer_id": 8, "class_id": 2},
        ],
    )
    classes = cabin_classes(spark)
    wanted = spark.createDataFrame([(1,)], "id bigint")
    one = booking.receipts(tickets, flights, fares, classes, wanted)
    assert tuples(one, "ticket_id", "price") == [(1, usd("101.00"))]
    mine = spark.createDataFrame([(8,)], "customer_id bigint")
    history = booking.ticket_history(tickets, flights, fares, classes, mine)
    assert tuples(history, "ticket_id", "price") == [(2, usd("202.00"))]
    everyone = booking.ticket_history(tickets, flights, fares, classes)
    assert tuples(booking.receipt_total(everyone, ["customer_id"]), "customer_id", "total") == [
        (7, usd("101.00")),
        (8, usd("202.00")),
    ]


def test_departure_label_has_minutes(spark):
    from wayfare.functions.labels import clock_label, departure_label

    df = spark.createDataFrame([(at("2024-11-05 21:07"),)], "t timestamp_ntz")
    assert df.select(departure_label(F.col("t")), clock_label(F.col("t"))).first() == (
        "Departing at 21:07 on 11-05-24",
        "09:07 PM",
    )
