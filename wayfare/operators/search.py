"""Itinerary search for a whole table of requests."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.constants import (
    CONNECTION_WAIT_MINUTES,
    DEFAULT_AIRLINE,
    DEFAULT_CLASS_ID,
    DEFAULT_DESTINATION,
    DEFAULT_MAX_LEGS,
    DEFAULT_ORIGIN,
    FORM_DATE_FORMAT,
    MAX_LEGS,
    MONEY,
)
from wayfare.functions.calendar import buckets_between, minutes, time_bucket_sql
from wayfare.operators.ranking import number_within
from wayfare.session import stage

# What makes two requests share one walk through the timetable.
SEARCH = ["airline", "origin", "dmin", "dmax", "class_id", "max_wait", "max_legs"]
TRIP = [*SEARCH, "destination"]

BUCKET_MINUTES = 120

# Departures of first legs that are walked together, see by_cell.
CELL_MINUTES = 720


# -- requests ---------------------------------------------------------------


def resolve_requests(forms: DataFrame, customers: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """Fill in defaults and parse the text fields of search forms.

    ``forms``: request_id, customer_id, airline, from_airport, to_airport, dep_date (text),
    class_id (text), max_legs (text). A missing field takes its default; the origin defaults to
    the customer's home airport first. ``today`` is the date used for a missing departure date.

    Returns (requests, refused forms with a reason).
    """
    # Only forms that need a home airport meet the customers. Anonymous forms, which may be most,
    # would otherwise all share the NULL key.
    home = customers.select(F.col("id").alias("customer_id"), "primary_airport_id")
    needs_home = F.col("from_airport").isNull() & F.col("customer_id").isNotNull()
    at_home = forms.filter(needs_home).join(home, "customer_id", "left")
    elsewhere = forms.filter(~needs_home).withColumn("primary_airport_id", F.lit(None).cast("string"))
    day = F.coalesce(
        F.when(F.col("dep_date").isNull(), F.to_date(F.lit(today))),
        F.try_to_timestamp("dep_date", F.lit(FORM_DATE_FORMAT)).cast("date"),
    )
    legs = F.when(F.col("max_legs").isNull(), F.lit(DEFAULT_MAX_LEGS)).otherwise(
        F.col("max_legs").try_cast("int")
    )
    cabin = F.when(F.col("class_id").isNull(), F.lit(DEFAULT_CLASS_ID)).otherwise(
        F.col("class_id").try_cast("int")
    )
    read = at_home.unionByName(elsewhere).select(
        "request_id",
        F.coalesce("airline", F.lit(DEFAULT_AIRLINE)).alias("airline"),
        F.coalesce("from_airport", "primary_airport_id", F.lit(DEFAULT_ORIGIN)).alias("origin"),
        F.coalesce("to_airport", F.lit(DEFAULT_DESTINATION)).alias("destination"),
        day.cast("timestamp_ntz").alias("dmin"),
        F.date_add(day, 1).cast("timestamp_ntz").alias("dmax"),
        cabin.alias("class_id"),
        minutes(CONNECTION_WAIT_MINUTES).alias("max_wait"),
        F.greatest(F.lit(0), F.least(legs, F.lit(MAX_LEGS))).alias("max_legs"),
        F.when(day.isNull(), "departure date")
        .when(legs.isNull(), "number of legs")
        .when(cabin.isNull(), "class")
        .alias("reason"),
    )
    good = read.filter(F.col("reason").isNull()).drop("reason")
    bad = read.filter(F.col("reason").isNotNull()).select("request_id", "reason")
    return good, bad


def most_legs(requests: DataFrame) -> int:
    """The largest leg limit of a batch of requests, at least 1: how many levels it is walked."""
    return max(1, requests.agg(F.max("max_legs")).first()[0] or 1)


def beyond_limit(requests: DataFrame, leg_limit: int) -> DataFrame:
    """Requests that ask for more legs than ``leg_limit``, which a search with it leaves out."""
    over = requests.filter(F.col("max_legs") > leg_limit)
    return over.select("request_id", F.lit("number of legs").alias("reason"))


def normal_requests(requests: DataFrame, leg_limit: int) -> DataFrame:
    """Requests that can match, with a limit of 1..leg_limit legs and no missing wait."""
    return requests.filter(f"dmin <= dmax and coalesce(max_legs, 1) <= {leg_limit}").selectExpr(
        "request_id",
        "airline",
        "origin",
        "destination",
        "dmin",
        "dmax",
        "cast(class_id as int) as class_id",
        "greatest(coalesce(max_wait, interval '0' minute), interval '0' minute) as max_wait",
        "cast(greatest(1, coalesce(max_legs, 1)) as int) as max_legs",
    )


def flying_times(flights: DataFrame) -> DataFrame:
    """One row: the shortest and longest time from departure to arrival."""
    flown = F.col("arrival_time") - F.col("departure_time")
    return flights.agg(F.min(flown).alias("shortest"), F.max(flown).alias("longest"))


def within_horizon(
    flights: DataFrame, requests: DataFrame, leg_limit: int | None = None, times: DataFrame | None = None
) -> DataFrame:
    """The flights any of the requests could use, by departure time.

    A first leg leaves inside the request's window, and each later leg at most one flight and
    one wait after it. The bounds are worked out first, from one row of totals each, so that they
    reach the scan as plain filters, and prune whole folders of flights stored by
    ``departure_date``. ``times`` are the table's :func:`flying_times`, which ``tables.write_flights`` keeps
    beside it; without them all flights are read for them.
    """
    asked = requests.agg(
        F.min("dmin").alias("first"),
        F.max("dmax").alias("last"),
        F.max("max_wait").alias("wait"),
        F.max("max_legs").alias("legs"),
    )
    asked = asked.first()
    span = (flying_times(flights) if times is None else times).first()
    if asked["first"] is None or asked["last"] is None or span["longest"] is None:
        return flights.filter("false")
    none, later = timedelta(0), max(1, leg_limit or asked["legs"] or 1) - 1
    first = asked["first"] + min(none, span["shortest"]) * later
    last = asked["last"] + (max(none, span["longest"]) + max(none, asked["wait"] or none)) * later
    usable = flights.filter(f"departure_time between timestamp_ntz'{first}' and timestamp_ntz'{last}'")
    if "departure_date" in flights.columns:
        usable = usable.filter(f"departure_date between date'{first.date()}' and date'{last.date()}'")
    return usable


def fares_of(fares: DataFrame, usable: DataFrame) -> DataFrame:
    """The fares, stored by ``departure_date``, of the dates of ``usable`` flights.

    The flights are those of :func:`within_horizon`, whose dates are a plain range; the same range
    then prunes the folders of the fares.
    """
    span = usable.agg(F.min("departure_date").alias("first"), F.max("departure_date").alias("last")).first()
    if span["first"] is None:
        return fares.filter("false")
    return fares.filter(f"departure_date between date'{span['first']}' and date'{span['last']}'")


# -- the walk ---------------------------------------------------------------


def offers(flights: DataFrame, fares: DataFrame, bucket_minutes: int = BUCKET_MINUTES) -> DataFrame:
    """Flights with one row per fare, placed in departure-time buckets."""
    # Tables stored by date are joined on it too, which keeps the work of each date together.
    dated = all("departure_date" in t.columns for t in (flights, fares))
    day = ["departure_date as o_day"] if dated else []
    keys = ["o_id", "o_day"] if dated else ["o_id"]
    prices = fares.selectExpr("flight_id as o_id", "cast(class_id as int) as o_class_id", "price as o_price", *day)
    return _moves(flights, bucket_minutes, *day).join(prices, keys).drop("o_day")


_LEG = """struct(o_id as id, o_number as number, o_from as departure_airport, o_departs as departure_time,
    o_to as arrival_airport, o_arrives as arrival_time, o_price as price)"""

# A path's next flight leaves from where the path ends, in one of its waiting buckets.
_LEAVES = "airline = o_airline and at = o_from and bucket = o_bucket"
MEETS = f"cell = o_cell and {_LEAVES}"
_SOLD = f"class_id = o_class_id and {_LEAVES}"

# The prices of a flight that is met, one per fare of the class asked for.
_PRICES = "transform(filter(o_fares, f -> f.class_id = class_id), f -> f.price)"

# Buckets from here down are before any calendar date and mark finished paths.
_FINISHED = -2_000_000_000


def _searches(requests: DataFrame, flights: DataFrame) -> DataFrame:
    """Distinct searches, each with the list of destinations asked of it.

    Only airports that some flight serves are kept, so a list is never longer than the airports
    are many, whatever text the requests hold. Duplicates fall away before the shuffle, so a
    search asked a billion times is still one small row.
    """
    served = flights.select(F.col("arrival_airport").alias("destination")).distinct()
    possible = requests.select(*SEARCH, "destination").distinct().join(served, "destination", "left_semi")
    return possible.groupBy(*SEARCH).agg(F.collect_set("destination").alias("wanted"))


def _cell(bucket: str, width: int) -> str:
    """SQL for the cell that a departure bucket of first legs belongs to."""
    return f"cast(floor({bucket} / {max(1, CELL_MINUTES // width)}) as int)"


def _priced(flights: DataFrame, fares: DataFrame, width: int) -> DataFrame:
    """The flights that are for sale, one row each, with their fares in a list."""
    dated = all("departure_date" in t.columns for t in (flights, fares))
    day = ["departure_date as o_day"] if dated else []
    keys = ["o_id", "o_day"] if dated else ["o_id"]
    sold = fares.filter("flight_id is not null").selectExpr(
        "flight_id as o_id", "struct(cast(class_id as int) as class_id, price) as fare", *day
    )
    sold = sold.groupBy(*keys).agg(F.collect_list("fare").alias("o_fares"))
    return _moves(flights, width, *day).join(sold, keys).drop("o_day")


def _moves(flights: DataFrame, width: int, *extra: str) -> DataFrame:
    return flights.selectExpr(
        "id as o_id",
        "airline as o_airline",
        "number as o_number",
        "departure_airport as o_from",
        "departure_time as o_departs",
        "arrival_airport as o_to",
        "arrival_time as o_arrives",
        f"{time_bucket_sql('departure_time', width)} as o_bucket",
        *extra,
    )


def _leads(moves: DataFrame, waits: DataFrame, width: int) -> DataFrame:
    """airline, from, leaves, at, bucket: where the flights of a bucket lead to, and in which buckets their
    passengers can go on. Many flights of a bucket lead to the same ones."""
    going_on = f"""sequence({time_bucket_sql('o_arrives', width)},
        {time_bucket_sql('(o_arrives + longest)', width)})"""
    return (
        moves.join(waits, "airline")
        .select(
            "airline",
            F.col("at").alias("from"),
            F.col("bucket").alias("leaves"),
            F.col("o_to").alias("at"),
            F.explode(F.expr(going_on)).alias("bucket"),
        )
        .distinct()
    )


def by_cell(
    searches: DataFrame, flights: DataFrame, fares: DataFrame, leg_limit: int, width: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The searches per departure bucket, and the flights, both dealt by airline and cell; and where the paths of
    a cell can be: airline, o_cell, at, bucket.

    A cell is half a day of first departures. A flight goes to every cell from whose first legs it could be
    met, so a path finds all its legs in one cell, and no path is ever shuffled: what moves are searches
    and flights. Which cells meet a flight is followed over airports and buckets alone, of which a cell has no
    more than the timetable, however many paths lead there.
    """
    asked = searches.select(
        "*", F.col("origin").alias("at"), F.explode(buckets_between("dmin", "dmax", width)).alias("bucket")
    ).withColumn("cell", F.expr(_cell("bucket", width)))
    place = ["airline", "cell", "at", "bucket"]
    places = [asked.select(*place).distinct()]
    if leg_limit > 1:
        moves = _moves(flights, width).selectExpr("o_airline as airline", "o_from as at", "o_bucket as bucket", "o_to", "o_arrives")
        leads = _leads(moves, searches.groupBy("airline").agg(F.max("max_wait").alias("longest")), width)
    for _ in range(1, leg_limit):
        here = places[-1].withColumnsRenamed({"at": "from", "bucket": "leaves"})
        places.append(here.join(leads, ["airline", "from", "leaves"]).select(*place).distinct())
    met = stage(reduce(DataFrame.unionByName, places).distinct().withColumnRenamed("cell", "o_cell"), "cells")
    offered = _priced(flights, fares, width).join(met, F.expr(_LEAVES)).drop("airline", "at", "bucket")
    offered = dealt_over_all(offered, "o_airline", "o_cell").hint("shuffle_hash")
    return dealt_over_all(asked, "airline", "cell"), offered, met


def dealt_over_all(df: DataFrame, *by: str) -> DataFrame:
    """The rows dealt over all shuffle partitions. What is dealt is small beside what a task makes of it, so
    partitions are not put together by their bytes, which leaves few tasks of uneven length."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _first_legs(asked: DataFrame, offered: DataFrame) -> DataFrame:
    """Flights leaving the origin within the window, both ends included."""
    # With a single leg allowed nothing can follow, so only the wanted arrivals matter.
    matches = f"""{MEETS} and dmin <= o_departs and o_departs <= dmax
        and (max_legs > 1 or array_contains(wanted, o_to))"""
    met = asked.join(offered, F.expr(matches)).withColumn("o_price", F.expr(f"explode({_PRICES})"))
    return met.selectExpr(
        *SEARCH,
        "cell",
        "wanted",
        "array(o_from) as path",
        "o_to as at",
        "o_arrives as at_time",
        f"array({_LEG}) as legs",
        "o_price as total",
        "false as finished",
    )


def _branches(paths: DataFrame, level: int, width: int) -> DataFrame:
    """Each path once as finished, if it is where it was wanted, and once per bucket in which a
    connection can leave, if it may hold more than ``level`` legs.

    A flight stands in one bucket only, so no pair meets twice. Finished paths get a bucket no
    flight is in, spread over many values so that they do not pile up in one partition.
    """
    finished = f"array({_FINISHED} - cast(pmod(xxhash64(legs[0].id), 100000) as int))"
    waiting = (
        f"sequence({time_bucket_sql('at_time', width)}, {time_bucket_sql('(at_time + max_wait)', width)})"
    )
    return paths.selectExpr(
        "* except (finished)",
        f"""explode(concat(
            if(finished or array_contains(wanted, at), {finished}, cast(array() as array<int>)),
            if(not finished and max_legs > {level}, {waiting}, cast(array() as array<int>)))) as bucket""",
    ).withColumn("finished", F.col("bucket") <= _FINISHED)


def _grow(paths: DataFrame, offered: DataFrame, level: int, leg_limit: int, width: int) -> DataFrame:
    """Append one connecting flight to each unfinished path of ``level`` legs.

    The left join lets finished paths through, so every level is computed once although it
    yields both results and the paths of the next level. Paths pass by a hash table of the cell's flights
    and are neither sorted nor kept.
    """
    branches = _branches(paths, level, width)
    matches = f"{MEETS} and at_time < o_departs and o_departs <= at_time + max_wait"
    if level + 1 == leg_limit:
        # Nothing follows this leg, so the arrival airport becomes part of the join key.
        branches = branches.withColumn("goal", F.expr("explode(if(finished, array(at), wanted))")).filter(
            "finished or not array_contains(path, goal)"
        )
        matches += " and goal = o_to"
    else:
        matches += f""" and not array_contains(path, o_to)
            and (max_legs > {level + 1} or array_contains(wanted, o_to))"""
    return (
        branches.join(offered, F.expr(matches), "left")
        .filter("finished or o_id is not null")
        .withColumn("o_price", F.expr(f"explode(if(finished, array(null), {_PRICES}))"))
        .selectExpr(
            *SEARCH,
            "cell",
            "wanted",
            "if(finished, path, concat(path, array(o_from))) as path",
            "if(finished, at, o_to) as at",
            "if(finished, at_time, o_arrives) as at_time",
            f"if(finished, legs, concat(legs, array({_LEG}))) as legs",
            f"if(finished, total, cast(total + o_price as {MONEY})) as total",
            "finished",
        )
    )


def _arrived(paths: DataFrame) -> DataFrame:
    return paths.filter("finished or array_contains(wanted, at)").selectExpr(
        *SEARCH,
        "cell",
        "at as destination",
        "legs.id as ids",
        "concat(path, array(at)) as path",
        "size(legs) as total_legs",
        "total as total_price",
        "legs",
    )


def _walk(
    requests: DataFrame, flights: DataFrame, fares: DataFrame, leg_limit: int, width: int
) -> DataFrame:
    """The itineraries of every distinct trip, dealt by airline and cell."""
    searches = stage(_searches(normal_requests(requests, leg_limit), flights), "searches")
    asked, offered, _ = by_cell(searches, flights, fares, leg_limit, width)
    paths = _first_legs(asked, offered)
    for level in range(1, leg_limit):
        paths = _grow(paths, offered, level, leg_limit, width)
    return _arrived(paths)


def search_trips(
    requests: DataFrame,
    flights: DataFrame,
    fares: DataFrame,
    leg_limit: int | None = None,
    bucket_minutes: int = BUCKET_MINUTES,
    itineraries: bool = True,
) -> DataFrame:
    """Itineraries of every distinct trip asked for; requests for the same trip share the work.

    Each level is one equi join on airline, cell, airport and time bucket with the exact time
    bounds as a join condition. There are as many levels as the requests ask for. ``leg_limit``
    saves finding that number; requests for more legs are then left out, and are what
    :func:`beyond_limit` gives. ``itineraries=False`` gives each trip that has any once, without them.
    """
    leg_limit = leg_limit or most_legs(requests)
    if not itineraries:
        return answered_trips(requests, flights, fares, leg_limit, bucket_minutes)
    return _walk(requests, flights, fares, leg_limit, bucket_minutes).drop("cell")


def answer_requests(requests: DataFrame, trips: DataFrame, leg_limit: int) -> DataFrame:
    """Give every request the itineraries of its trip."""
    asked = normal_requests(requests, leg_limit).select("request_id", *TRIP)
    extra = [c for c in trips.columns if c not in TRIP]
    return asked.join(trips, TRIP).select("request_id", "airline", "class_id", *extra)


def requests_by_cell(requests: DataFrame, leg_limit: int, width: int) -> DataFrame:
    """The requests, dealt to the cells in which their itineraries are found."""
    first, last = (_cell(time_bucket_sql(t, width), width) for t in ("dmin", "dmax"))
    asked = normal_requests(requests, leg_limit).select(
        "request_id", *TRIP, F.explode(F.expr(f"sequence({first}, {last})")).alias("cell")
    )
    return dealt_over_all(asked, "airline", "cell").hint("shuffle_hash")


def search_itineraries(
    requests: DataFrame,
    flights: DataFrame,
    fares: DataFrame,
    leg_limit: int | None = None,
    bucket_minutes: int = BUCKET_MINUTES,
    form: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row per request and itinerary: ids, path, total_legs, total_price, legs.

    ``form`` shapes the itineraries of the trips before their requests get them, so that its work is done once
    per trip. It keeps the columns of the trip and ``cell``, and may make several rows of one.
    """
    leg_limit = leg_limit or most_legs(requests)
    trips = _walk(requests, flights, fares, leg_limit, bucket_minutes)
    trips = form(trips) if form else trips
    found = trips.join(requests_by_cell(requests, leg_limit, bucket_minutes), [*TRIP, "cell"])
    return found.select("request_id", "airline", "class_id", *(c for c in trips.columns if c not in (*TRIP, "cell")))


def ranked_itineraries(
    requests: DataFrame,
    flights: DataFrame,
    fares: DataFrame,
    leg_limit: int | None = None,
    bucket_minutes: int = BUCKET_MINUTES,
    details: bool = True,
) -> DataFrame:
    """Itineraries with ``rank`` 1, 2, … per request by total price, then by flight ids.

    Ranks belong to a trip, so they are worked out once per trip and not once per request. Without
    ``details`` the columns path and legs are left out, which makes the rows to sort much smaller.
    """
    leg_limit = leg_limit or most_legs(requests)
    trips = search_trips(requests, flights, fares, leg_limit, bucket_minutes)
    if not details:
        trips = trips.drop("path", "legs")
    trips = number_within(stage(trips, "trips"), TRIP, ["total_price", "ids"], "rank")
    return answer_requests(requests, trips, leg_limit)


# -- trips that have an itinerary -------------------------------------------


def reach_labels(
    requests: DataFrame, moves: DataFrame, legs: int, bucket_minutes: int = BUCKET_MINUTES
) -> DataFrame:
    """airline, at, bucket, reach: the destinations (destination, legs) that leaving an airport in a bucket
    can still lead to, with the fewest legs, up to ``legs`` of them.

    Walked backwards from the destinations that requests name, over flights whether sold or not. A bucket is labelled where some flight
    leaves in it, so a label may promise too much for a path that arrives late in the bucket, and never
    too little.
    """
    goals = requests.select("airline", "destination", "max_wait").groupBy("airline", "destination")
    goals = goals.agg(F.max("max_wait").alias("wait"))
    waits = goals.groupBy("airline").agg(F.max("wait").alias("longest"))
    last = moves.join(goals.select("airline", F.col("destination").alias("o_to")), ["airline", "o_to"])
    known = last.select("airline", "at", "bucket", F.col("o_to").alias("destination")).distinct()
    levels = [known.withColumn("legs", F.lit(1))]
    if legs > 1:
        leads = _leads(moves, waits, bucket_minutes)
    for n in range(2, legs + 1):
        # Who starts at the destination cannot come back to it.
        earlier = leads.join(known, ["airline", "at", "bucket"]).where(F.col("from") != F.col("destination"))
        known = earlier.select("airline", F.col("from").alias("at"), F.col("leaves").alias("bucket"), "destination").distinct()
        levels.append(known.withColumn("legs", F.lit(n)))
    fewest = reduce(DataFrame.unionByName, levels).groupBy("airline", "at", "bucket", "destination").agg(F.min("legs").alias("legs"))
    return fewest.groupBy("airline", "at", "bucket").agg(F.collect_list(F.struct("destination", "legs")).alias("reach"))


def _reached(searches: DataFrame, hops: DataFrame, labels: DataFrame | None, legs: int, width: int) -> DataFrame:
    """The searches with each wanted destination that some path of exactly ``legs`` legs leads to.

    Paths over the same airports that arrive at the same time go on in the same way, so each level keeps one
    of them: there are never more than airports and times allow, however many flights make them up.
    """
    asked = searches.select(
        "*", F.col("origin").alias("at"), F.explode(buckets_between("dmin", "dmax", width)).alias("bucket")
    )
    first = f"{_SOLD} and dmin <= o_departs and o_departs <= dmax"
    if legs == 1:
        found = asked.join(hops, F.expr(f"{first} and array_contains(wanted, o_to)"))
        return found.select(*SEARCH, F.col("o_to").alias("destination")).distinct()
    state = [*SEARCH, "wanted", "visited", "at", "at_time"]
    paths = asked.join(hops, F.expr(first)).selectExpr(
        *SEARCH, "wanted", "array(o_from) as visited", "o_to as at", "o_arrives as at_time"
    )
    waiting = f"sequence({time_bucket_sql('at_time', width)}, {time_bucket_sql('(at_time + max_wait)', width)})"
    in_time = f"{_SOLD} and at_time < o_departs and o_departs <= at_time + max_wait"
    for level in range(1, legs):
        open_ = f"""filter(wanted, w -> not array_contains(visited, w)
            and exists(reach, r -> r.destination = w and r.legs <= {legs - level}))"""
        branches = paths.distinct().selectExpr("*", f"explode({waiting}) as bucket")
        branches = branches.join(labels, ["airline", "at", "bucket"]).withColumn("goals", F.expr(open_))
        branches = branches.where("size(goals) > 0")
        if level < legs - 1:
            grown = branches.join(hops, F.expr(f"{in_time} and not array_contains(visited, o_to)"))
            paths = grown.selectExpr(
                *SEARCH,
                "wanted",
                "array_sort(array_union(visited, array(o_from))) as visited",
                "o_to as at",
                "o_arrives as at_time",
            ).select(*state)
    last = branches.select(*SEARCH, "at", "at_time", "bucket", F.explode("goals").alias("goal")).distinct()
    found = last.join(hops, F.expr(f"{in_time} and goal = o_to"))
    return found.select(*SEARCH, F.col("goal").alias("destination")).distinct()


def answered_trips(
    requests: DataFrame,
    flights: DataFrame,
    fares: DataFrame,
    leg_limit: int | None = None,
    bucket_minutes: int = BUCKET_MINUTES,
) -> DataFrame:
    """The trips of :func:`search_trips`, each once and without its itineraries.

    Itineraries may be as many as the cube of the flights, and whether there is one needs none of them:
    a destination is looked for with one leg, and only if not found with two, and so on.
    """
    leg_limit = leg_limit or most_legs(requests)
    offered = offers(flights, fares, bucket_minutes)
    hops = offered.select("o_airline", "o_class_id", "o_from", "o_to", "o_departs", "o_arrives", "o_bucket").distinct()
    hops = stage(hops, "hops")
    searches = stage(_searches(normal_requests(requests, leg_limit), flights), "searches")
    answered = []
    for legs in range(1, leg_limit + 1):
        goals = searches.select(*SEARCH, F.explode("wanted").alias("destination"))
        labels = None
        if legs > 1:
            moves = hops.selectExpr("o_airline as airline", "o_from as at", "o_bucket as bucket", "o_to", "o_arrives").distinct()
            labels = reach_labels(goals, moves, legs - 1, bucket_minutes)
        answered.append(stage(_reached(searches, hops, labels, legs, bucket_minutes), "answered"))
        missing = goals.where(f"max_legs > {legs}").join(answered[-1], TRIP, "left_anti")
        searches = stage(missing.groupBy(*SEARCH).agg(F.collect_set("destination").alias("wanted")), "searches")
        if searches.isEmpty():
            break
    return reduce(DataFrame.unionByName, answered)


# -- results ----------------------------------------------------------------


def itinerary_legs(itineraries: DataFrame) -> DataFrame:
    """One row per leg, numbered from 1, with the flight's details and its own fare.

    Itineraries of trips, which have no request yet, keep the columns of their trip and ``cell``.
    """
    asked = "request_id" in itineraries.columns
    whose = ["request_id"] if asked else [c for c in (*TRIP, "cell") if c != "airline"]
    return itineraries.selectExpr(
        *whose, "ids", "path", "total_legs", "airline", "total_price", "posexplode(legs) as (_at, _leg)"
    ).selectExpr(
        *whose,
        "ids",
        "_leg.id as id",
        "path",
        "_at + 1 as leg",
        "total_legs",
        "airline",
        "_leg.number as number",
        "_leg.departure_airport as departure_airport",
        "_leg.departure_time as departure_time",
        "_leg.arrival_airport as arrival_airport",
        "_leg.arrival_time as arrival_time",
        "_leg.price as price",
        "total_price",
    )


def deal_itineraries(itineraries: DataFrame) -> DataFrame:
    """The itineraries dealt by ranges of request and flight ids, for their legs to be sorted by :func:`order_legs`.

    An itinerary is one row here and a row per leg later, so it is moved before its legs are listed, and
    without the columns that its legs tell.
    """
    dealt = itineraries.select("request_id", "airline", "total_price", "legs").repartitionByRange(
        "request_id", F.col("legs.id")
    )
    return dealt.selectExpr(
        "request_id",
        "legs.id as ids",
        "concat(legs.departure_airport, array(element_at(legs, -1).arrival_airport)) as path",
        "size(legs) as total_legs",
        "airline",
        "total_price",
        "legs",
    )


def order_legs(legs: DataFrame, dealt: bool = False) -> DataFrame:
    """Legs by request, itinerary and departure. Those of :func:`deal_itineraries` are ``dealt``: all that
    is left to do is to sort each range where it is."""
    by = ["request_id", "ids", "departure_time"]
    return legs.sortWithinPartitions(*by) if dealt else legs.orderBy(*by)


def booking_tag(ids: Column, class_id: Column) -> Column:
    """JSON list of [flight id, class id] pairs that puts an itinerary into a cart."""
    return F.to_json(F.transform(ids, lambda i: F.array(i, class_id.cast("bigint"))))


def requests_without_trip(requests: DataFrame, trips: DataFrame) -> DataFrame:
    """Requests whose trip is not among ``trips``, as :func:`search_trips` gives them for the same
    requests. Nothing is spread over the requests to find that out."""
    legs = most_legs(requests)
    asked = normal_requests(requests, legs).select("request_id", *TRIP)
    answered = asked.join(trips.select(*TRIP).distinct(), TRIP, "left_semi").select("request_id")
    return requests.join(answered, "request_id", "left_anti")


def unmatched_requests(requests: DataFrame, itineraries: DataFrame) -> DataFrame:
    """Requests without a single itinerary."""
    answered = itineraries.select("request_id").distinct()
    return requests.join(answered, "request_id", "left_anti")


def class_list(classes: DataFrame) -> DataFrame:
    return classes.select("id", "display_name").orderBy("id")
