import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import usd
from tests.helpers import tuples
from wayfare.functions.geo import great_circle_miles
from wayfare.functions.money import ticket_price
from wayfare.operators.fares import price_flights, split_fares
from wayfare.sources.tables import cabin_classes

AIRPORTS = [
    {"iata": "ORD", "lat": 41.97859955, "long": -87.90480042},
    {"iata": "ATL", "lat": 33.63669968, "long": -84.42810059},
    {"iata": "JFK", "lat": 40.63980103, "long": -73.77890015},
    {"iata": "CWT", "lat": -33.84, "long": 148.65},
]


def miles(spark, a, b, mode="reference"):
    row = spark.createDataFrame([(*a, *b)], "a double, b double, c double, d double")
    return row.select(great_circle_miles(*[F.col(x) for x in "abcd"], mode=mode)).first()[0]


def test_known_distance(spark):
    assert miles(spark, (41.97859955, -87.90480042), (33.63669968, -84.42810059)) == pytest.approx(606, abs=2)


def test_same_point_is_zero_however_it_rounds(spark):
    points = spark.range(500).selectExpr("-80 + id * 0.3137 as lat", "-170 + id * 0.6211 as long")
    own = great_circle_miles(F.col("lat"), F.col("long"), F.col("lat"), F.col("long"))
    assert points.filter(own.isNull() | F.isnan(own) | (F.abs(own) > 1)).count() == 0


def test_beyond_a_quarter_turn(spark):
    near, far = (0.0, 0.0), (0.0, 120.0)
    assert miles(spark, near, far) < 0
    assert miles(spark, near, far, "exact") == pytest.approx(3958.75 * math.radians(120), abs=1)


def test_modes_agree_within_a_quarter_turn(spark):
    a, b = (10.0, 20.0), (40.0, 60.0)
    assert miles(spark, a, b) == pytest.approx(miles(spark, a, b, "exact"), abs=1e-6)
    with pytest.raises(ValueError):
        miles(spark, a, b, "other")


def test_null_coordinates_have_no_distance(spark):
    assert miles(spark, (None, 1.0), (2.0, 3.0)) is None


def test_half_cents_round_up(spark):
    df = spark.createDataFrame([((231.005 - 230) / 0.032,), (0.0,)], "m double")
    assert tuples(df, ticket_price(F.col("m"))) == [(usd("230.00"),), (usd("231.01"),)]


def flights(make, *pairs):
    rows = [{"id": i, "departure_airport": a, "arrival_airport": b} for i, (a, b) in enumerate(pairs)]
    return make("flight", rows)


def test_fee_and_seats_per_class(spark, make):
    out = price_flights(flights(make, ("ORD", "ATL")), make("airport", AIRPORTS), cabin_classes(spark))
    rows = tuples(out, "class_id", "capacity", "price")
    base = rows[0][2]
    assert [(c, n, p - base) for c, n, p in rows] == [
        (1, 48, usd("0.00")), (2, 8, usd("59.00")), (3, 8, usd("99.00")), (4, 4, usd("199.00")),
    ]
    assert usd("249") < base < usd("250")


def test_unknown_airport_has_no_fare(spark, make):
    out = price_flights(flights(make, ("ORD", "XXX")), make("airport", AIRPORTS), cabin_classes(spark))
    assert out.count() == 0


def test_class_without_seats_is_refused(make):
    classes = make("class", [{"id": 1, "fee": usd("0")}, {"id": 9, "fee": usd("5")}])
    good, refused = split_fares(price_flights(flights(make, ("ORD", "JFK")), make("airport", AIRPORTS), classes))
    assert tuples(good, "class_id") == [(1,)]
    assert tuples(refused, "class_id") == [(9,)]


def test_every_flight_meets_every_class(spark, make):
    airports, some = make("airport", AIRPORTS), flights(make, ("ORD", "JFK"), ("JFK", "ATL"))
    many = make("class", [{"id": i, "fee": usd("1")} for i in range(250)])
    assert price_flights(some, airports, many).select("flight_id", "class_id").distinct().count() == 500
    assert price_flights(some, airports, cabin_classes(spark)).count() == 8
    assert price_flights(some, airports, make("class", [])).count() == 0


def test_class_without_fee_has_no_price(make):
    classes = make("class", [{"id": 1}])
    out = price_flights(flights(make, ("ORD", "JFK")), make("airport", AIRPORTS), classes)
    assert tuples(out, "price") == [(None,)]
