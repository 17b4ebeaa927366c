import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import at, usd
from tests.helpers import hours, ordered, tuples
from wayfare.operators import ranking, search
from wayfare.session import stage

REQUEST = (
    "request_id bigint, airline string, origin string, destination string, dmin timestamp_ntz, "
    "dmax timestamp_ntz, class_id int, max_wait interval day to second, max_legs int"
)


def flight(i, a, b, leaves, arrives, airline="XX"):
    return {
        "id": i, "airline": airline, "number": 100 + i, "departure_time": at(leaves),
        "arrival_time": at(arrives), "departure_airport": a, "arrival_airport": b,
    }


def request(spark, *rows):
    return spark.createDataFrame(rows, REQUEST)


def ask(i=1, a="A", b="C", day="2024-01-01", legs=3, cabin=1, wait=hours(2), airline="XX"):
    start = at(f"{day} 00:00:00")
    return (i, airline, a, b, start, start + hours(24), cabin, wait, legs)


def fares_for(make, flights, price=lambda i: usd(f"{100 + i}.00"), cabins=(1, 2)):
    return make(
        "flight_class",
        [{"flight_id": f["id"], "class_id": c, "price": price(f["id"])} for f in flights for c in cabins],
    )


def find(spark, make, flights, *requests, fares=None, **options):
    fares = fares_for(make, flights) if fares is None else fares
    return search.search_itineraries(request(spark, *requests), make("flight", flights), fares, **options)


def ids(df):
    return tuples(df, "request_id", "ids")


def test_wait_is_open_at_arrival_and_closed_at_the_limit(spark, make):
    flights = [
        flight(1, "A", "B", "2024-01-01 08:00", "2024-01-01 09:00"),
        flight(2, "B", "C", "2024-01-01 09:00:00", "2024-01-01 12:00"),
        flight(3, "B", "C", "2024-01-01 09:00:01", "2024-01-01 12:00"),
        flight(4, "B", "C", "2024-01-01 11:00:00", "2024-01-01 12:00"),
        flight(5, "B", "C", "2024-01-01 11:00:01", "2024-01-01 12:00"),
    ]
    assert ids(find(spark, make, flights, ask())) == [(1, [1, 3]), (1, [1, 4])]


def test_window_includes_both_midnights_and_binds_only_the_first_leg(spark, make):
    flights = [
        flight(1, "A", "C", "2024-01-01 00:00:00", "2024-01-01 02:00"),
        flight(2, "A", "C", "2024-01-02 00:00:00", "2024-01-02 02:00"),
        flight(3, "A", "C", "2024-01-02 00:00:01", "2024-01-02 02:00"),
        flight(4, "A", "B", "2024-01-01 23:00:00", "2024-01-02 00:30"),
        flight(5, "B", "C", "2024-01-02 01:30:00", "2024-01-02 03:00"),
    ]
    assert ids(find(spark, make, flights, ask())) == [(1, [1]), (1, [2]), (1, [4, 5])]


def test_no_airport_is_visited_twice(spark, make):
    flights = [
        flight(1, "A", "B", "2024-01-01 08:00", "2024-01-01 09:00"),
        flight(2, "B", "A", "2024-01-01 09:30", "2024-01-01 10:00"),
        flight(3, "A", "C", "2024-01-01 10:30", "2024-01-01 11:00"),
    ]
    assert ids(find(spark, make, flights, ask())) == [(1, [3])]


def test_self_loops(spark, make):
    flights = [
        flight(1, "A", "A", "2024-01-01 08:00", "2024-01-01 09:00"),
        flight(2, "A", "C", "2024-01-01 09:30", "2024-01-01 10:00"),
        flight(3, "C", "C", "2024-01-01 10:30", "2024-01-01 11:00"),
        flight(4, "C", "C", "2024-01-01 11:30", "2024-01-01 12:00"),
    ]
    out = find(spark, make, flights, ask(1), ask(2, b="A"))
    # C-C once may follow an arrival in C; a second loop there would revisit it.
    assert ids(out) == [
        (1, [1, 2]), (1, [1, 2, 3]), (1, [1, 2, 4]), (1, [2]), (1, [2, 3]), (1, [2, 4]), (2, [1]),
    ]


def test_a_path_through_the_destination_ends_there(spark, make):
    flights = [
        flight(1, "A", "C", "2024-01-01 08:00", "2024-01-01 09:00"),
        flight(2, "C", "B", "2024-01-01 09:30", "2024-01-01 10:00"),
        flight(3, "B", "C", "2024-01-01 10:30", "2024-01-01 11:00"),
    ]
    assert ids(find(spark, make, flights, ask())) == [(1, [1])]


@pytest.mark.parametrize(
    "legs, expected",
    [(-1, [1]), (0, [1]), (1, [1]), (2, [1, 2]), (3, [1, 2, 3]), (9, [1, 2, 3, 4]), (None, [1])],
)
def test_leg_limits(spark, make, legs, expected):
    flights = [
        flight(1, "A", "C", "2024-01-01 08:00", "2024-01-01 09:00"),
        flight(2, "A", "B", "2024-01-01 08:00", "2024-01-01 09:00"),
        flight(3, "B", "C", "2024-01-01 09:30", "2024-01-01 10:00"),
        flight(4, "B", "D", "2024-01-01 09:30", "2024-01-01 10:00"),
        flight(5, "D", "C", "2024-01-01 10:30", "2024-01-01 11:00"),
        flight(6, "D", "E", "2024-01-01 10:30", "2024-01-01 11:00"),
        flight(7, "E", "C", "2024-01-01 11:30", "2024-01-01 12:00"),
    ]
    out = find(spark, make, flights, ask(legs=legs))
    assert sorted(r[0] for r in tuples(out, "total_legs")) == expected


def test_more_legs_on_request(spark, make):
    flights = [
        flight(i, a, b, f"2024-01-01 {7 + i:02}:00", f"2024-01-01 {7 + i:02}:30")
        for i, (a, b) in enumerate(["AB", "BD", "DE", "EF", "FC"])
    ]
    assert ids(find(spark, make, flights, ask(legs=5))) == [(1, [0, 1, 2, 3, 4])]
    assert ids(find(spark, make, flights, ask(legs=4))) == []


def test_a_leg_limit_refuses_requests_for_more(spark, make):
    flights = [flight(1, "A", "C", "2024-01-01 08:00", "2024-01-01 09:00")]
    asked = [ask(1, legs=2), ask(2, legs=5), ask(3, legs=None)]
    assert ids(find(spark, make, flights, *asked, leg_limit=3)) == [(1, [1]), (3, [1])]
    refused = search.beyond_limit(request(spark, *asked), 3)
    assert tuples(refused, "request_id", "reason") == [(2, "number of legs")]


def test_many_destinations_share_one_walk(spark, make):
    flights = [flight(i, "A", f"D{i}", "2024-01-01 08:00", "2024-01-01 09:00") for i in range(40)]
    asked = [ask(i, b=f"D{i}") for i in range(60)]  # the last twenty are served by no flight
    assert ids(find(spark, make, flights, *asked)) == [(i, [i]) for i in range(40)]
    trips = search.search_trips(request(spark, *asked), make("flight", flights), fares_for(make, flights))
    left = search.requests_without_trip(request(spark, *asked), trips)
    assert tuples(left, "request_id") == [(i,) for i in range(40, 60)]


@pytest.mark.parametrize("seed, airports, width", [(1, "ABCDE", 120), (2, "ABCDEFGH", 45), (3, "ABCDEFGHIJKL", 600)])
def test_trips_without_itineraries_are_those_with_any(spark, make, seed, airports, width):
    """Searched for one level after another, on timetables of one to many legs, loops and flights back in time."""
    rng, start = random.Random(seed), at("2024-01-01 00:00:00")
    flights = []
    for i in range(120):
        leaves, lasts = rng.randrange(0, 1800, 15), rng.randrange(-30, 240, 15)
        times = [(start + dt.timedelta(minutes=m)).isoformat() for m in (leaves, leaves + lasts)]
        flights.append(flight(i, rng.choice(airports), rng.choice(airports), *times, airline=rng.choice(["XX", "YY"])))
    fares = fares_for(make, flights, lambda i: None if i % 7 == 0 else usd("1.00"), (1, 2)).where("(flight_id + class_id) % 5 <> 0")
    asked = [
        ask(
            i, rng.choice([*airports, None]), rng.choice([*airports, "?"]), legs=rng.choice([0, 1, 2, 3, 4, None]),
            cabin=rng.choice([1, 2, None]), wait=hours(rng.choice([0, 1, 2, 5])), airline=rng.choice(["XX", "YY", None]),
        )
        for i in range(150)
    ]
    tables = request(spark, *asked), make("flight", flights), fares
    every = search.search_trips(*tables, bucket_minutes=width)
    once = search.search_trips(*tables, bucket_minutes=width, itineraries=False)
    assert tuples(once, *search.TRIP) == tuples(every.select(*search.TRIP).distinct(), *search.TRIP)
    assert every.agg(F.max("total_legs")).first()[0] > 1
    assert search.requests_without_trip(tables[0], once).count() == search.requests_without_trip(tables[0], every).count() > 0


def test_a_trip_found_nonstop_is_not_walked_further(spark, make, monkeypatch):
    flights = [flight(1, "A", "C", "2024-01-01 08:00", "2024-01-01 09:00"), flight(2, "A", "B", "2024-01-01 08:00", "2024-01-01 09:00")]
    walked, reached = [], search._reached
    monkeypatch.setattr(search, "_reached", lambda s, h, l, legs, w: walked.append((legs, s.count())) or reached(s, h, l, legs, w))
    tables = request(spark, ask(1), ask(2, b="B"), ask(3, a="B")), make("flight", flights), fares_for(make, flights)
    once = search.search_trips(*tables, itineraries=False)
    assert tuples(search.requests_without_trip(tables[0], once), "request_id") == [(3,)]
    assert walked == [(1, 2), (2, 1), (3, 1)]


def test_other_airlines_and_classes_do_not_connect(spark, make):
    flights = [
        flight(1, "A", "B", "2024-01-01 08:00", "2024-01-01 09:00"),
        flight(2, "B", "C", "2024-01-01 09:30", "2024-01-01 10:00", airline="YY"),
        flight(3, "A", "C", "2024-01-01 08:00", "2024-01-01 09:00"),
    ]
    fares = make("flight_class", [{"flight_id": i, "class_id": 1, "price": usd("1")} for i in (1, 2)])
    assert find(spark, make, flights, ask(), fares=fares).count() == 0


def test_missing_price_makes_the_total_unknown(spark, make):
    flights = [
        flight(1, "A", "B", "2024-01-01 08:00", "2024-01-01 09:00"),
        flight(2, "B", "C", "2024-01-01 09:30", "2024-01-01 10:00"),
        flight(3, "A", "C", "2024-01-01 09:30", "2024-01-01 10:00"),
    ]
    fares = fares_for(make, flights, lambda i: None if i == 2 else usd("100.00"))
    out = search.ranked_itineraries(request(spark, ask()), make("flight", flights), fares)
    assert tuples(out, "rank", "ids", "total_price") == [(1, [3], usd("100.00")), (2, [1, 2], None)]


def test_requests_that_cannot_match(spark, make):
    flights = [flight(1, "A", "C", "2024-01-01 08:00", "2024-01-01 09:00")]
    backwards = list(ask(2))
    backwards[4], backwards[5] = backwards[5], backwards[4]
    asked = [ask(1), tuple(backwards), ask(3, a=None), ask(4, b=None), ask(5, a="C", b="C")]
    found = find(spark, make, flights, *asked)
    assert ids(found) == [(1, [1])]
    assert tuples(search.unmatched_requests(request(spark, *asked), found), "request_id") == [
        (2,), (3,), (4,), (5,),
    ]


def test_no_wait_means_no_connection(spark, make):
    flights = [
        flight(1, "A", "B", "2024-01-01 08:00", "2024-01-01 09:00"),
        flight(2, "B", "C", "2024-01-01 09:30", "2024-01-01 10:00"),
        flight(3, "A", "C", "2024-01-01 09:30", "2024-01-01 10:00"),
    ]
    out = find(spark, make, flights, ask(1, wait=None), ask(2, wait=hours(-1)), ask(3, wait=hours(0)))
    assert ids(out) == [(1, [3]), (2, [3]), (3, [3])]


def test_many_destinations_of_one_search(spark, make):
    places = [f"P{i:02}" for i in range(40)]
    flights = [flight(i, "A", p, "2024-01-01 08:00", "2024-01-01 09:00") for i, p in enumerate(places)]
    out = find(spark, make, flights, *[ask(i, b=p) for i, p in enumerate(places)])
    assert ids(out) == ordered((i, [i]) for i in range(40))


def test_legs_tags_and_order(spark, make):
    flights = [
        flight(1, "A", "B", "2024-01-01 08:00", "2024-01-01 09:00"),
        flight(2, "B", "C", "2024-01-01 09:30", "2024-01-01 10:00"),
    ]
    found = find(spark, make, flights, ask(cabin=2))
    legs = search.order_legs(search.itinerary_legs(found)).collect()
    assert [(r.leg, r.id, r.number, r.price, r.total_price, r.path) for r in legs] == [
        (1, 1, 101, usd("101.00"), usd("203.00"), ["A", "B", "C"]),
        (2, 2, 102, usd("102.00"), usd("203.00"), ["A", "B", "C"]),
    ]
    tag = found.select(search.booking_tag(F.col("ids"), F.col("class_id"))).first()[0]
    assert tag == "[[1,2],[2,2]]"


# -- against a plain search --------------------------------------------------


def plain_search(flights, prices, asked, leg_limit=3):
    """All itineraries of one request by walking every flight, in Python."""
    i, airline, origin, goal, dmin, dmax, cabin, wait, legs = asked
    legs = max(1, min(legs, leg_limit))
    usable = [f for f in flights if f["airline"] == airline and (f["id"], cabin) in prices]
    found = []

    def walk(taken, visited):
        last = taken[-1]
        if last["arrival_airport"] == goal:
            total = sum(prices[f["id"], cabin] for f in taken)
            found.append((i, [f["id"] for f in taken], total))
        if len(taken) >= legs:
            return
        for f in usable:
            gap = f["departure_time"] - last["arrival_time"]
            if (
                f["departure_airport"] == last["arrival_airport"]
                and dt.timedelta(0) < gap <= wait
                and f["arrival_airport"] not in visited
            ):
                walk([*taken, f], [*visited, f["departure_airport"]])

    for f in usable:
        if f["departure_airport"] == origin and dmin <= f["departure_time"] <= dmax:
            walk([f], [origin])
    return found


@pytest.mark.parametrize("seed, width", [(1, 120), (2, 30), (3, 600)])
def test_equals_plain_search_on_random_timetables(spark, make, seed, width):
    rng = random.Random(seed)
    start = at("2024-01-01 00:00:00")
    flights = []
    for i in range(500):
        leaves = start + dt.timedelta(minutes=rng.randrange(0, 2 * 1440, 15))
        flights.append(
            {
                "id": i,
                "airline": rng.choice(["XX", "YY"]),
                "number": i,
                "departure_time": leaves,
                "arrival_time": leaves + dt.timedelta(minutes=rng.randrange(-30, 200, 15)),
                "departure_airport": rng.choice("ABCDE"),
                "arrival_airport": rng.choice("ABCDE"),
            }
        )
    prices = {
        (f["id"], c): usd(f"{rng.randrange(100, 400)}.50") for f in flights for c in (1, 2) if rng.random() < 0.9
    }
    fares = make("flight_class", [{"flight_id": f, "class_id": c, "price": p} for (f, c), p in prices.items()])
    asked = []
    for i in range(30):
        day = start + dt.timedelta(minutes=rng.randrange(0, 1440, 60))
        wait = dt.timedelta(minutes=rng.choice([0, 45, 120, 300]))
        asked.append(
            (i, rng.choice(["XX", "YY"]), rng.choice("ABC"), rng.choice("ABCDE"), day,
             day + hours(rng.choice([6, 24])), rng.choice([1, 2]), wait, rng.choice([0, 1, 2, 3, 3]))
        )
    found = find(spark, make, flights, *asked, fares=fares, bucket_minutes=width)
    expected = [row for a in asked for row in plain_search(flights, prices, a)]
    assert len(expected) > 100
    assert tuples(found, "request_id", "ids", "total_price") == ordered(expected)

    if width == 120:
        ranked = search.ranked_itineraries(request(spark, *asked), make("flight", flights), fares)
        order = {}
        for i, path, total in sorted(expected, key=lambda r: (r[0], r[2], r[1])):
            order.setdefault(i, []).append(path)
        wanted = [(i, n, path) for i, paths in order.items() for n, path in enumerate(paths, 1)]
        assert tuples(ranked, "request_id", "rank", "ids") == ordered(wanted)


# -- forms -------------------------------------------------------------------


def test_resolving_forms(spark, make):
    forms = spark.createDataFrame(
        [
            (1, None, None, None, None, None, None, None),
            (2, 7, None, None, None, "1/5/2024", "2", "-4"),
            (3, 7, "YY", "AAA", "BBB", "12/31/2024", "3", "9"),
            (4, None, None, None, None, "2024-01-05", None, None),
            (5, None, None, None, None, "02/30/2024", None, None),
            (6, None, None, None, None, None, None, "many"),
            (7, None, None, None, None, None, "first", None),
        ],
        "request_id bigint, customer_id bigint, airline string, from_airport string, to_airport string, "
        "dep_date string, class_id string, max_legs string",
    )
    customers = make("customer", [{"id": 7, "primary_airport_id": "HOM"}])
    good, refused = search.resolve_requests(forms, customers, "2024-03-01")
    day = dt.datetime
    assert tuples(good, "request_id", "airline", "origin", "destination", "dmin", "dmax", "class_id", "max_legs") == [
        (1, "DL", "ORD", "ATL", day(2024, 3, 1), day(2024, 3, 2), 1, 3),
        (2, "DL", "HOM", "ATL", day(2024, 1, 5), day(2024, 1, 6), 2, 0),
        (3, "YY", "AAA", "BBB", day(2024, 12, 31), day(2025, 1, 1), 3, 3),
    ]
    assert good.select("max_wait").first()[0] == hours(2)
    assert tuples(refused, "request_id", "reason") == [
        (4, "departure date"), (5, "departure date"), (6, "number of legs"), (7, "class"),
    ]


# -- ranking -----------------------------------------------------------------


def test_numbering_a_group_that_spans_partitions(spark):
    # Two thirds of the rows share one key and half of those one price.
    df = spark.range(30000).selectExpr(
        "if(id % 3 = 0, id % 50, 7) as key", "if(id % 2 = 0, 1, id % 11) as price", "id"
    )
    df = stage(df.repartition(6, "id"), "rank-input")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = stage(search.number_within(df, ["key"], ["price", "id"], "rank"), "rank-output")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    plain = df.selectExpr("*", "row_number() over (partition by key order by price, id) as rank")
    assert out.count() == 30000
    assert out.exceptAll(plain).count() == 0


def test_groups_are_cut_into_slices_only_where_they_are_large(spark, monkeypatch):
    """Rows of small groups are neither staged nor moved twice; rows with a NULL key are left out."""
    labels = []
    monkeypatch.setattr(ranking, "stage", lambda df, label: labels.append(label) or stage(df, label))
    df = spark.range(0, 9000, 1, 4).selectExpr("if(id % 3 = 0, id % 50, if(id = 1, null, 7)) as key", "id % 11 as price", "id")
    plain = df.where("key is not null").selectExpr("*", "cast(row_number() over (partition by key order by price, id) as bigint) as rank")

    small = ranking.number_within(df, ["key"], ["price", "id"], "rank")
    assert labels == ["large-groups"]
    assert sorted(small.collect()) == sorted(plain.collect())

    monkeypatch.setattr(ranking, "GROUP", 1000)
    cut = ranking.number_within(df, ["key"], ["price", "id"], "rank")
    assert "numbered" in labels
    assert sorted(cut.collect()) == sorted(plain.collect())


def test_a_hub_is_split_over_tasks(spark):
    """Two thirds of all flights leave one hub within one bucket; adaptive execution splits them."""
    flights = spark.range(0, 1800, 1, 8).selectExpr(
        "id", "'XX' as airline", "cast(id as int) as number",
        """timestamp_ntz'2024-01-01 00:00:00'
            + make_dt_interval(0, 0, cast(if(id % 3 = 0, id % 1200, 601 + id % 100) as int)) as departure_time""",
        """timestamp_ntz'2024-01-01 00:00:00'
            + make_dt_interval(0, 0, cast(if(id % 3 = 0, 600, 760) as int)) as arrival_time""",
        "if(id % 3 = 0, concat('N', id % 40), 'HUB') as departure_airport",
        "if(id % 3 = 0, 'HUB', concat('N', id % 40)) as arrival_airport",
    )
    fares = flights.selectExpr("id as flight_id", "1 as class_id", "cast(id % 300 as decimal(19,2)) as price")
    asked = spark.range(40).selectExpr(
        "id as request_id", "'XX' as airline", "concat('N', id) as origin", "concat('N', (id + 7) % 40) as destination",
        "timestamp_ntz'2024-01-01 00:00:00' as dmin", "timestamp_ntz'2024-01-01 10:00:00' as dmax",
        "1 as class_id", "make_dt_interval(0, 2) as max_wait", "3 as max_legs",
    )
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8000",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    plain = stage(search.search_itineraries(asked, flights, fares).select("request_id", "ids"), "hub")
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        split = search.search_itineraries(asked, flights, fares).select("request_id", "ids")
        rows = split.collect()
        assert "skew=true" in split._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(rows) > 100
    assert ordered(tuple(r) for r in rows) == tuples(plain, "request_id", "ids")


def test_legs_of_dealt_itineraries_are_ordered_as_by_a_sort_of_all_legs(spark, make):
    flights = [
        flight(i, a, b, f"2024-01-01 {leaves}", f"2024-01-01 {arrives}")
        for i, (a, b, leaves, arrives) in enumerate(
            [
                ("A", "B", "08:00", "09:00"), ("B", "C", "10:00", "11:00"), ("A", "C", "08:00", "09:00"),
                ("B", "D", "09:30", "10:00"), ("D", "C", "11:00", "12:00"), ("A", "B", "08:00", "09:00"),
            ]
        )
    ]
    # Requests and flights that come twice give equal itineraries, whose legs lie mixed.
    found = find(spark, make, [*flights, flights[3]], *[ask(i % 7) for i in range(20)])
    dealt = search.deal_itineraries(found)
    assert tuples(dealt, *dealt.columns) == tuples(found, *dealt.columns)
    rows = [tuple(r) for r in search.order_legs(search.itinerary_legs(dealt), dealt=True).collect()]
    whole = [tuple(r) for r in search.order_legs(search.itinerary_legs(found)).collect()]
    key = [(r[0], r[1], r[9]) for r in rows]
    assert key == sorted(key) == [(r[0], r[1], r[9]) for r in whole]
    assert sorted(rows) == sorted(whole) and len(rows) > 100


def test_itineraries_are_moved_for_the_order_before_their_legs_are_listed(spark, make):
    found = find(spark, make, [flight(1, "A", "C", "2024-01-01 08:00", "2024-01-01 09:00")], ask())
    legs = search.order_legs(search.itinerary_legs(search.deal_itineraries(found)), dealt=True)
    plan = legs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("posexplode") < plan.index("RepartitionByExpression") and "Sort [" in plan
    moved = plan[plan.index("RepartitionByExpression"):].splitlines()[1]
    assert moved.count("#") and "path" not in moved and "total_legs" not in moved


def test_paths_go_through_no_shuffle(spark, make):
    """Searches, flights and requests are dealt once; every join of a walk takes its paths where they are."""
    flights = [flight(i, "AB"[i % 2], "BC"[i % 2], f"2024-01-01 {8 + i:02}:00", f"2024-01-01 {8 + i:02}:50") for i in range(6)]
    found = find(spark, make, flights, ask(), ask(2, legs=2), leg_limit=3)
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in plan]
    joins = [i for i, line in enumerate(plan) if "ShuffledHashJoin" in line]
    assert len(joins) == 4
    for i, line in enumerate(plan):
        if "Exchange" in line:
            end = next((k for k in range(i + 1, len(plan)) if depth[k] <= depth[i]), len(plan))
            assert not any(i < k < end for k in joins)


def test_legs_days_apart_are_found_in_the_cell_of_the_first(spark, make):
    flights = [
        flight(1, "A", "B", "2024-01-01 23:00", "2024-01-04 10:00"),
        flight(2, "A", "B", "2024-01-01 08:00", "2024-01-01 07:00"),
        flight(3, "B", "D", "2024-01-04 11:00", "2024-01-06 01:00"),
        flight(4, "B", "C", "2024-01-01 07:30", "2024-01-01 09:00"),
        flight(5, "D", "C", "2024-01-06 03:00", "2024-01-06 04:00"),
        flight(5, "D", "C", "2024-01-06 03:00", "2024-01-06 04:00"),
        flight(6, "D", "C", "2024-01-06 03:01", "2024-01-06 04:00"),
    ]
    rows = fares_for(make, flights).unionByName(fares_for(make, flights[2:3], cabins=(1, None)))
    start = at("2024-01-01 00:00:00")
    long = (2, "XX", "A", "C", start, start + hours(24 * 9), 1, hours(2), 3)
    found = find(spark, make, flights, ask(legs=3), long, fares=rows)
    # Flight 5 is there twice and has two fares for that, flight 3 has its fare twice: eight ways, for either request.
    assert ids(found) == ordered([(r, i) for r in (1, 2) for i in [[2, 4]] + [[1, 3, 5]] * 8])


def test_itineraries_take_their_form_once_per_trip(spark, make):
    flights = [
        flight(1, "A", "B", "2024-01-01 08:00", "2024-01-01 09:00"),
        flight(2, "B", "C", "2024-01-01 09:30", "2024-01-01 10:00"),
        flight(3, "A", "C", "2024-01-01 09:30", "2024-01-01 10:00"),
    ]
    asked = [ask(i) for i in range(6)]
    found = find(spark, make, flights, *asked, form=lambda trips: trips.withColumn("ids", F.array_join("ids", "-")))
    assert ids(found) == [(i, x) for i in range(6) for x in ("1-2", "3")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("array_join(")
    # A form may make several rows of an itinerary, here its legs.
    legs = find(spark, make, flights, *asked, form=search.itinerary_legs)
    whole = search.itinerary_legs(find(spark, make, flights, *asked))
    assert tuples(legs, *whole.columns) == tuples(whole, *whole.columns) and whole.count() == 18


def test_a_walk_has_a_task_for_every_shuffle_partition(spark, make):
    """Its tables are a few bytes here, which adaptive execution would put into one task."""
    found = find(spark, make, [flight(1, "A", "C", "2024-01-01 08:00", "2024-01-01 09:00")], ask())
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
