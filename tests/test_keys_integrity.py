"""Key allocation, quarantined reads, stored layouts and integrity of growing tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import usd
from tests.helpers import tuples
from tests.test_search import fares_for, flight
from wayfare.operators import booking, incremental, quality
from wayfare.plans import pipelines
from wayfare.session import stage
from wayfare.sources import keys, tables
from wayfare.sources.manifest import Conflict, Store
from wayfare.sources.schemas import schema_of

# -- keys --------------------------------------------------------------------


def forms(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def test_runs_get_keys_without_gaps_and_the_same_ones_again(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    first = keys.allocate(store, forms(spark, *"dbca"), ["name"], "one")
    assert tuples(first, "id", "name") == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    store.write(forms(spark, "killed"), "keys-two")
    assert tuples(keys.allocate(store, forms(spark, *"yx"), ["name"], "two"), "id") == [(5,), (6,)]
    again = keys.allocate(store, forms(spark, *"dbca").repartition(7), ["name"], "one")
    assert tuples(again, "id", "name") == tuples(first, "id", "name")
    assert keys.allocate(store, forms(spark), ["name"], "none").count() == 0
    assert tuples(keys.allocate(store, forms(spark, None, "z"), ["name"], "three"), "id", "name") == [(7, "z"), (8, None)]
    assert keys.last_key(store) == 8


def test_a_run_that_loses_the_race_takes_the_next_keys(spark, tmp_path, monkeypatch):
    store, other = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    plain, raced = store.commit, []

    def commit(*args):
        if not raced:
            raced.append(keys.allocate(other, forms(spark, *"xyz"), ["name"], "fast"))
        return plain(*args)

    monkeypatch.setattr(store, "commit", commit)
    assert tuples(keys.allocate(store, forms(spark, *"ab"), ["name"], "slow"), "id") == [(4,), (5,)]
    with pytest.raises(Conflict):
        other.commit(Store(spark, str(tmp_path / "none")).latest(), {}, {"late": 0})


def test_numbers_are_dense_over_many_slices_without_one_window(spark):
    rows = spark.range(0, 5000, 1, 9).select((F.col("id") * 7919 % 10_007).alias("n"))
    numbered = keys.dense_numbers(rows, ["n"], "id", 101)
    found = tuples(numbered, "id", "n")
    assert [i for i, _ in found] == list(range(101, 5101))
    assert [n for _, n in found] == sorted(n for _, n in found)


# -- quarantine ---------------------------------------------------------------


def test_broken_lines_go_to_the_rejects_and_counts_add_up(spark, tmp_path):
    lines = [
        "flight_id,class_id,capacity,price",
        "1,1,48,100.50",
        "2,x,48,100.50",
        "3,1",
        "4,1,,",
        "5,1,48,1.00,extra",
        "six,1,many,1.00",
        "99999999999999999999,1,4,1.00",
    ]
    (tmp_path / "f.csv").write_text("\n".join(lines) + "\n")
    rows, rejects = tables.read_quarantined(spark, "flight_class", str(tmp_path / "f.csv"))
    assert rows.schema == schema_of("flight_class")
    assert tuples(rows, "flight_id", "class_id", "capacity", "price") == [(1, 1, 48, usd("100.50")), (4, 1, None, None)]
    found = {r["flight_id"]: (r["broken_row"], list(r["bad_columns"])) for r in rejects.collect()}
    assert found["2"] == (None, ["class_id"]) and found["six"] == (None, ["flight_id", "capacity"])
    assert found["3"][0] == "3,1" and found["5"][0] == "5,1,48,1.00,extra"
    assert found["99999999999999999999"] == (None, ["flight_id"])
    assert rows.count() + rejects.count() == len(lines) - 1
    assert rows.select("flight_id").count() + rejects.select("broken_row").count() == len(lines) - 1


def test_json_lines_and_padded_codes(spark, tmp_path):
    good = '{"id": 1, "airline": "XX ", "number": 7, "departure_time": "2024-01-01T08:00:00", "departure_airport": "AAA"}'
    (tmp_path / "f.json").write_text(good + '\n{"id": 2, "number": "seven"}\n{"id": 3,\n')
    rows, rejects = tables.read_quarantined(spark, "flight", str(tmp_path / "f.json"), "json")
    assert tuples(rows, "id", "airline", "number", "departure_time") == [(1, "XX", 7, dt.datetime(2024, 1, 1, 8))]
    assert sorted((r["broken_row"] or "", list(r["bad_columns"])) for r in rejects.collect()) == [("", ["number"]), ('{"id": 3,', [])]
    with pytest.raises(ValueError):
        tables.read_quarantined(spark, "flight", "x", "parquet")


# -- layouts ------------------------------------------------------------------


def test_stored_joins_shuffle_nothing(spark, make, tmp_path):
    flights = [flight(i, "A", "B", "2024-01-01 08:00", "2024-01-01 09:00") for i in range(40)]
    prices = fares_for(make, flights)
    tickets = make("ticket", [{"id": i, "customer_id": i % 5, "flight": i % 45, "class_id": 1 + i % 3} for i in range(120)])
    classes = make("class", [{"id": c, "display_name": f"c{c}"} for c in (1, 2, 3)])
    pipelines.save_for_joins(make("flight", flights), prices, tickets, "stored", str(tmp_path), 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        out = pipelines.stored_receipts(spark, "stored", classes)
        expected = booking.ticket_history(tickets, make("flight", flights), prices, classes)
        assert tuples(out, *expected.columns) == tuples(expected, *expected.columns) and out.count() > 0
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        narrow = spark.table("stored_ticket").join(spark.table("stored_fares"), F.expr("flight = flight_id")).join(
            spark.table("stored_flight").withColumnRenamed("id", "of"), F.expr("flight_id = of")
        )
        assert "Exchange" not in narrow._jdf.queryExecution().executedPlan().toString()
        whole = pipelines.stored_receipts(spark, "stored", classes)._jdf.queryExecution().executedPlan().toString()
        assert whole.count("Exchange") == 2  # the class names, and what meets them
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("flight", "fares", "ticket"):
            spark.sql(f"drop table if exists stored_{name}")


# -- integrity ----------------------------------------------------------------


def held(known):
    return incremental.Known(*[stage(df, "known") for df in (known.keys, known.repeated, known.orphans)])


def test_parts_checked_by_themselves_equal_the_whole_tables(spark, make):
    rng = random.Random(6)
    rows = {
        "class": [{"id": i} for i in (1, 2, 2, 3)],
        "flight": [{"id": rng.choice([0, 5, 32_768, 32_769, 70_000, *range(100, 130)])} for _ in range(60)] + [{"id": None}] * 2,
        "flight_class": [
            {"flight_id": rng.choice([0, 5, 32_768, None, *range(95, 135)]), "class_id": rng.choice([1, 2, 3, 9])} for _ in range(200)
        ],
    }
    steps = [("flight_class", 0, 3), ("flight", 0, 2), ("flight_class", 1, 3), ("class", 0, 1), ("flight", 1, 2), ("flight_class", 2, 3)]
    known = incremental.Known.nothing(spark)
    for table, part, of in steps:
        known = held(incremental.add_partition(known, table, make(table, rows[table][part::of])))
    whole = {t: make(t, r) for t, r in rows.items()}
    names = ["rule", "table", "key", "violations"]
    pk = quality.primary_key_report({t: df.dropna(subset=quality.PRIMARY_KEYS[t]) for t, df in whole.items()})
    assert tuples(incremental.report(known), *names) == tuples(pk.unionByName(quality.foreign_key_report(whole)), *names)


def test_a_part_is_checked_without_the_table_it_joins(spark, make, tmp_path):
    for part in range(3):
        make("flight", [{"id": 10 * part + i} for i in range(10)]).write.parquet(f"{tmp_path}/{part}")
    known = incremental.Known.nothing(spark)
    for part in range(3):
        after = incremental.add_partition(known, "flight", spark.read.parquet(f"{tmp_path}/{part}"))
        read = {f.split("/")[-2] for df in (after.keys, after.repeated) for f in df.inputFiles() if f"{tmp_path}/" in f}
        assert read == {str(part)}
        known = held(after)
    assert incremental.report(known).count() == 0
    twice = incremental.add_partition(known, "flight", make("flight", [{"id": 7}, {"id": 99}]))
    assert tuples(incremental.report(twice), "key", "violations") == [("7", 2)]


def test_keys_that_are_no_numbers_are_refused(spark, make):
    with pytest.raises(ValueError):
        incremental.add_partition(incremental.Known.nothing(spark), "customer_address", make("customer_address", []))


def test_entries_with_missing_values_are_not_repeated(make):
    row = {"id": 1, "airline": "XX", "number": 1, "departure_airport": "AAA", "arrival_airport": "BBB"}
    assert quality.domain_report({"flight_schedule": make("flight_schedule", [row, row | {"id": 2}])}).count() == 0
