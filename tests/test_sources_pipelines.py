import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import at, usd
from tests.helpers import hours, tuples
from tests.test_search import ask, fares_for, find, flight, ids, request
from wayfare.operators import search
from wayfare.plans import catalog, pipelines
from wayfare.session import TASK_BYTES, bound_tasks, staging_root
from wayfare.sources import tables
from wayfare.sources.schemas import TABLES


def test_csv_codes_lose_their_padding(spark, tmp_path):
    (tmp_path / "airport.csv").write_text("iata,name,lat,long,city,country,tz\nAB ,Abc,1.5,2.5,Town,US,UTC\n")
    out = tables.read_table(spark, "airport", str(tmp_path), "csv")
    assert tuples(out, "iata", "lat") == [("AB", 1.5)]


def test_bad_csv_fails_loudly(spark, tmp_path):
    (tmp_path / "class.csv").write_text("id,display_name,fee\none,Economy,0\n")
    with pytest.raises(Exception):
        tables.read_table(spark, "class", str(tmp_path), "csv").collect()


@pytest.mark.parametrize("format", ["parquet", "orc", "json"])
def test_formats_round_trip(spark, make, tmp_path, format):
    rows = [{"id": 1, "price": usd("12.30"), "leg": 1, "flight": 2, "customer_id": 3, "paid_with": 4, "class_id": 1}]
    make("ticket", rows).write.format(format).save(str(tmp_path / "t"))
    out = tables.read_table(spark, "ticket", str(tmp_path / "t"), format)
    assert tuples(out, "id", "price", "class_id") == [(1, usd("12.30"), 1)]


def test_all_tables_read_with_their_types(spark, make, tmp_path):
    for table in TABLES:
        make(table, []).write.parquet(f"{tmp_path}/{table}")
    read = tables.read_tables(spark, str(tmp_path))
    assert set(read) == set(TABLES)
    assert all(df.count() == 0 for df in read.values())


def test_flights_are_stored_by_day(spark, make, tmp_path):
    flights = [flight(i, "A", "B", f"2024-01-0{1 + i % 3} 08:00", f"2024-01-0{1 + i % 3} 09:00") for i in range(30)]
    tables.write_flights(make("flight", flights), str(tmp_path / "flight"))
    out = tables.read_flights(spark, str(tmp_path / "flight"))
    assert out.count() == 30
    one = out.filter(F.col("departure_date") == dt.date(2024, 1, 2))
    assert one.count() == 10
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(departure_date" in plan


def test_bucketed_tables_join_without_a_shuffle(spark, make, tmp_path):
    flights = [flight(i, "A", "B", "2024-01-01 08:00", "2024-01-01 09:00") for i in range(50)]
    tables.save_bucketed(make("flight", flights), "b_flight", ["id"], 4, path=f"{tmp_path}/f")
    tables.save_bucketed(fares_for(make, flights), "b_fare", ["flight_id"], 4, path=f"{tmp_path}/c")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        offered = search.offers(spark.table("b_flight"), spark.table("b_fare"))
        assert offered.count() == 100
        assert "Exchange" not in offered._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("drop table b_flight")
        spark.sql("drop table b_fare")


def test_staging_folder_comes_from_the_session(spark):
    assert staging_root(spark) == spark.conf.get("spark.checkpoint.dir")


def test_horizon_keeps_every_usable_flight_and_prunes_folders(spark, make, tmp_path):
    flights = [
        flight(1, "A", "B", "2024-01-05 22:00", "2024-01-06 01:00"),
        flight(2, "B", "D", "2024-01-06 03:00", "2024-01-06 07:00"),
        flight(3, "D", "C", "2024-01-06 09:00", "2024-01-06 10:00"),
        flight(4, "A", "C", "2024-01-01 09:00", "2024-01-01 10:00"),
        flight(5, "A", "C", "2024-01-09 09:00", "2024-01-09 10:00"),
    ]
    tables.write_flights(make("flight", flights), str(tmp_path / "flight"))
    stored = tables.read_flights(spark, str(tmp_path / "flight"))
    asked = request(spark, ask(1, day="2024-01-05"))
    near = search.within_horizon(stored, asked)
    assert tuples(near, "id") == [(1,), (2,), (3,)]
    prices = fares_for(make, flights)
    assert ids(search.search_itineraries(asked, near, prices)) == [(1, [1, 2, 3])]
    assert ids(find(spark, make, flights, ask(1, day="2024-01-05"))) == [(1, [1, 2, 3])]
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(departure_date" in plan
    assert search.within_horizon(stored, asked.limit(0)).count() == 0


def test_timetable_to_booking(spark, make, tmp_path):
    root, out = tmp_path / "in", tmp_path / "out"
    airports = [
        {"iata": a, "name": a, "lat": 40.0 + i, "long": -80.0, "city": a, "country": "US", "tz": "UTC"}
        for i, a in enumerate(["AAA", "BBB", "CCC"])
    ]
    entries = [
        {
            "id": i, "airline": "XX", "number": i, "valid_from": dt.date(2024, 1, 1), "valid_to": dt.date(2024, 1, 8),
            "departure_airport": a, "departure_min": m, "arrival_airport": b, "arrival_min": m + 60,
            "days": "1111111", "leg": 1, "duration": dt.timedelta(hours=1),
        }
        for i, a, b, m in [(1, "AAA", "BBB", 480), (2, "BBB", "CCC", 570)]
    ]
    classes = [{"id": 1, "display_name": "Economy", "fee": usd("0")}, {"id": 9, "display_name": "X", "fee": usd("1")}]
    for name, rows in [
        ("airport", airports),
        ("airline", [{"callsign": "XX", "name": "X", "country": "US"}]),
        ("class", classes),
        ("flight_schedule", entries),
    ]:
        make(name, rows).write.parquet(f"{root}/{name}")

    built = pipelines.build_timetable(spark, str(root), str(out))
    assert built["flight"].count() == 14
    assert built["flight_class"].count() == 14
    assert spark.read.parquet(f"{out}/refused_fares").count() == 14
    assert built["report"].count() == 0

    forms = spark.createDataFrame(
        [(1, None, "XX", "AAA", "CCC", "1/3/2024", "1", "3"), (2, None, "XX", "CCC", "AAA", "1/3/2024", "1", "3"),
         (3, None, "XX", "AAA", "CCC", "never", "1", "3")],
        "request_id bigint, customer_id bigint, airline string, from_airport string, to_airport string, "
        "dep_date string, class_id string, max_legs string",
    )
    pipelines.answer_searches(
        forms, make("customer", []), built["flight"], built["flight_class"], "2024-01-01", str(out)
    )
    found = spark.read.parquet(f"{out}/itineraries")
    assert tuples(found, "request_id", "rank", "path") == [(1, 1, ["AAA", "BBB", "CCC"])]
    assert tuples(spark.read.parquet(f"{out}/unanswered"), "request_id") == [(2,)]
    assert tuples(spark.read.parquet(f"{out}/refused"), "request_id") == [(3,)]

    legs = search.itinerary_legs(found)
    cart = legs.selectExpr(
        "request_id as cart_id", "7L as customer_id", "cast(leg as bigint) as seq", "id as flight_id",
        "1 as class_id", "900L as paid_with",
    )
    for _ in range(2):
        pipelines.book_carts(cart, built["flight_class"], str(out), "first")
    tickets = tables.read_tickets(spark, str(out))
    assert tickets.count() == 2
    assert tickets.agg(F.sum("price")).first()[0] == found.first()["total_price"]
    assert found.select(F.col("legs")[1]["departure_time"] - F.col("legs")[0]["arrival_time"]).first()[0] < hours(2)
    assert at("2024-01-03 08:00") == found.first()["legs"][0]["departure_time"]


def test_the_package_reaches_executors_that_lack_it(spark, monkeypatch):
    import zipfile

    from wayfare import session

    shipped = []
    monkeypatch.setattr(type(spark.sparkContext), "addPyFile", lambda _, path: shipped.append(path))
    session.ship(spark)
    names = set(zipfile.ZipFile(shipped[0]).namelist())
    assert {"wayfare/__init__.py", "wayfare/streaming/keyed_carts.py", "wayfare/session.py"} <= names


@pytest.mark.parametrize("name", ["integrity_fk", "cart_totals", "cart_totals_cross"])
def test_queries_bound_what_one_task_takes_from_a_shuffle(spark, tmp_path, name):
    for table, row in {
        "nation": "0 as n_nationkey, 'N' as n_name",
        "region": "0 as r_regionkey, 'R' as r_name",
        "customer": "7L as c_custkey, 'C' as c_name, 0 as c_nationkey, 'S' as c_mktsegment",
        "part": "1L as p_partkey, 1 as p_size",
        "orders": "1L as o_orderkey, 7L as o_custkey",
        "lineitem": "1L as l_orderkey, 1L as l_partkey, 1L as l_suppkey, 1 as l_linenumber, 2D as l_quantity, 3D as l_extendedprice",
    }.items():
        spark.sql(f"select {row}").write.parquet(f"{tmp_path}/{table}.parquet")
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    build = catalog.queries()[name]
    # A session built elsewhere, without a size of its own, and one with a size that stays.
    for given, kept in [(None, TASK_BYTES), ("5m", "5m")]:
        session = spark.newSession()
        session.conf.set(size, given) if given else session.conf.unset(size)
        assert build(session, str(tmp_path)).count() > 0
        assert session.conf.get(size) == kept


def test_large_shuffles_are_dealt_over_tasks_of_a_bounded_size(spark):
    session = spark.newSession()
    session.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    session.conf.set("spark.sql.shuffle.partitions", "16")
    session.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    bound_tasks(session)
    # 40 MB that do not compress: one task by the default of 64 MB.
    rows = session.range(2_000_000).selectExpr("xxhash64(id) as a", "xxhash64(id + 1) as b", "xxhash64(-id) as c")
    assert rows.repartition("a").rdd.getNumPartitions() > 2
