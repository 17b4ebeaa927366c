"""The engine's tables derived from the driver's test tables.

Each property reads the parquet files it needs and shapes them by fixed arithmetic; the same
rules are written as SQL in ``wayfare.plans.oracle``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from wayfare.operators.fares import price_flights
from wayfare.operators.ranking import number_within
from wayfare.sources.tables import cabin_classes

# Columns of the driver tables that are used here.
_RAW = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "part": "p_partkey bigint, p_size int",
    "orders": "o_orderkey bigint, o_custkey bigint",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string",
}


def _node(number: str) -> str:
    return f"concat('N', lpad(cast({number} as string), 2, '0'))"


def _carrier(number: str) -> str:
    return f"concat('R', cast({number} as string))"


def _minutes(count: str) -> str:
    return f"make_dt_interval(0, 0, cast({count} as int))"


def _at(minute: str) -> str:
    return f"timestamp_ntz'2024-01-01 00:00:00' + {_minutes(minute)}"


TICKET_BASE = 2**62

_CART = [
    "l_orderkey as cart_id",
    "o_custkey as customer_id",
    "if(l_quantity >= 49, -1, l_partkey) as flight_id",
    "cast(1 + l_linenumber % 4 as int) as class_id",
    "o_custkey as paid_with",
]


class StandIn:
    """Lazily built tables over one folder of driver files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.schema(_RAW[table]).parquet(f"{self.folder}/{table}.parquet")

    @cached_property
    def customers(self) -> int:
        return self.raw("customer").count()

    @property
    def classes(self) -> DataFrame:
        return cabin_classes(self.spark)

    @property
    def airports(self) -> DataFrame:
        return self.raw("nation").selectExpr(
            f"{_node('n_nationkey')} as iata",
            "n_name as name",
            "cast(25 + (n_nationkey * 7) % 40 as double) as lat",
            "cast(-70 - (n_nationkey * 13) % 60 as double) as long",
        )

    @property
    def airlines(self) -> DataFrame:
        return self.raw("region").selectExpr(f"{_carrier('r_regionkey')} as callsign", "r_name as name")

    @property
    def schedule(self) -> DataFrame:
        start = "date_add(date'2024-01-01', p_size)"
        flown = "45 + (p_partkey * 11) % 300"
        return self.raw("part").selectExpr(
            "p_partkey as id",
            f"{_carrier('p_partkey % 5')} as airline",
            "cast(p_partkey % 9000 + 100 as int) as number",
            f"{start} as valid_from",
            f"date_add({start}, cast(p_partkey % 21 as int)) as valid_to",
            f"{_node('p_partkey % 25')} as departure_airport",
            "cast((p_partkey * 37) % 1440 as int) as departure_min",
            f"{_node('(p_partkey * 7 + 3) % 27')} as arrival_airport",
            f"cast((p_partkey * 37 + {flown}) % 1440 as int) as arrival_min",
            "lpad(bin(p_partkey % 128), 7, '0') as days",
            "1 as leg",
            # Every tenth entry states a duration its clock times do not bear out.
            f"{_minutes(f'{flown} + if(p_partkey % 10 = 0, 800, 0)')} as duration",
        )

    @property
    def flights(self) -> DataFrame:
        leaves = "(o_orderkey * 7919) % 43200"
        flown = "60 + (o_orderkey * 31) % 240"
        return self.raw("orders").selectExpr(
            "o_orderkey as id",
            f"{_carrier('o_orderkey % 5')} as airline",
            "cast(o_orderkey % 9000 + 100 as int) as number",
            f"{_at(leaves)} as departure_time",
            f"{_at(f'{leaves} + {flown}')} as arrival_time",
            f"{_minutes(flown)} as duration",
            f"{_node('o_custkey % 25')} as departure_airport",
            f"{_node('(o_custkey % 25 + 1 + (o_orderkey div 5) % 24) % 25')} as arrival_airport",
        )

    @property
    def fares(self) -> DataFrame:
        return price_flights(self.flights, self.airports, self.classes)

    @property
    def requests(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey as request_id",
            f"{_carrier('c_custkey % 5')} as airline",
            f"{_node('c_nationkey')} as origin",
            f"{_node('(c_nationkey + 1 + c_custkey % 24) % 25')} as destination",
            f"{_at('c_custkey % 30 * 1440')} as dmin",
            f"{_at('c_custkey % 30 * 1440 + 1440')} as dmax",
            "cast(1 + c_custkey % 4 as int) as class_id",
            f"{_minutes('120')} as max_wait",
            "3 as max_legs",
        )

    @property
    def forms(self) -> DataFrame:
        """Search forms: some fields missing, some dates and numbers unreadable."""
        return self.raw("customer").selectExpr(
            "c_custkey as request_id",
            "if(c_custkey % 13 <> 0, c_custkey, null) as customer_id",
            f"if(c_custkey % 6 <> 0, {_carrier('c_custkey % 5')}, null) as airline",
            f"if(c_custkey % 3 <> 0, {_node('c_custkey % 25')}, null) as from_airport",
            f"if(c_custkey % 4 <> 0, {_node('(c_custkey + 7) % 25')}, null) as to_airport",
            """case when c_custkey % 19 = 0 then 'soon' when c_custkey % 5 <> 0
                then concat('1/', lpad(cast(1 + c_custkey % 30 as string), 2, '0'), '/2024') end as dep_date""",
            "if(c_custkey % 7 <> 0, cast(1 + c_custkey % 4 as string), null) as class_id",
            """case when c_custkey % 23 = 0 then 'any'
                when c_custkey % 8 <> 0 then cast(c_custkey % 9 - 2 as string) end as max_legs""",
        )

    @property
    def cart_events(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id as seq",
            "cast(ts as timestamp) as ts",
            "user_id as customer_id",
            """case event_type when 'click' then 'add' when 'view' then 'add' when 'error' then 'remove'
                when 'signup' then 'clear' else 'checkout' end as action""",
            "event_id % 8 as flight_id",
            "cast(1 + event_id % 2 as int) as class_id",
        )

    @property
    def _order_lines(self) -> DataFrame:
        return self.raw("lineitem").join(
            self.raw("orders").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey"
        )

    @property
    def cart_items(self) -> DataFrame:
        """Every order as a cart, its entries in no order."""
        return self._order_lines.selectExpr(*_CART)

    @cached_property
    def carts(self) -> DataFrame:
        """The same carts with their entries numbered, as booking needs them."""
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
        return number_within(self._order_lines, ["l_orderkey"], order, "seq").selectExpr(*_CART, "seq")

    @property
    def tickets(self) -> DataFrame:
        # Their ids lie above those of all tickets that the carts can be booked into.
        lines = self._order_lines.groupBy("l_orderkey", "l_linenumber")
        return lines.agg({"l_extendedprice": "max", "l_partkey": "min", "o_custkey": "min"}).selectExpr(
            f"{TICKET_BASE} + l_orderkey * 10 + l_linenumber as id",
            "cast(round(`max(l_extendedprice)` / 100, 2) as decimal(19,2)) as price",
            "0 as leg",
            "`min(l_partkey)` as flight",
            "`min(o_custkey)` as customer_id",
            "`min(o_custkey)` as paid_with",
            "cast(1 + l_linenumber % 4 as int) as class_id",
        )

    @property
    def addresses(self) -> DataFrame:
        nations = self.raw("nation").withColumnRenamed("n_nationkey", "c_nationkey")
        return (
            self.raw("customer")
            .join(nations, "c_nationkey")
            .selectExpr(
                "c_custkey as id",
                "concat(c_name, ' St') as line_1",
                "if(c_custkey % 3 = 0, concat('Suite ', cast(c_custkey % 90 as string)), '') as line_2",
                "c_mktsegment as city",
                "if(c_custkey % 5 <> 0, concat('P', cast(c_custkey % 10 as string)), null) as province",
                "lpad(cast(c_custkey as string), 5, '0') as postal_code",
                "n_name as country",
            )
        )

    @property
    def accounts(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey as id",
            "c_name as name",
            "concat(c_name, '@Example.com') as email",
            "if(c_custkey % 7 <> 0, c_custkey, null) as primary_payment_id",
            "c_custkey as primary_address_id",
            f"{_node('c_nationkey')} as primary_airport_id",
        )

    @property
    def address_links(self) -> DataFrame:
        customers = self.raw("customer")
        own = customers.selectExpr("c_custkey as customer_id", "c_custkey as address_id")
        shared = customers.filter("c_custkey % 2 = 0").selectExpr(
            "c_custkey as customer_id", f"(c_custkey + 1) % {self.customers} as address_id"
        )
        return own.unionByName(shared)

    @property
    def payments(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey as id",
            "c_custkey as customer_id",
            "make_date(cast(2025 + c_custkey % 5 as int), cast(1 + c_custkey % 12 as int), 1) as exp",
            "c_name as card_holder",
            "concat('Visa ', lpad(cast(c_custkey % 10000 as string), 4, '0')) as display_name",
            "c_custkey as billing_address",
        )

    @property
    def account_changes(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id as seq",
            "user_id as customer_id",
            """case event_type when 'view' then 'add_address' when 'error' then 'remove_address'
                when 'click' then 'set_primary_address' when 'purchase' then 'set_primary_payment'
                else 'add_payment' end as action""",
            f"event_id % {self.customers} as target_id",
        )

    @property
    def change_log(self) -> DataFrame:
        """Account changes with their forms. Keys come again and again, some for stored rows."""
        forms = self.raw("events").selectExpr(
            "event_id as seq",
            "user_id as customer_id",
            """case event_type when 'view' then 'add_address' when 'error' then 'remove_address'
                when 'click' then 'add_payment' when 'purchase' then 'remove_payment'
                else 'set_primary_payment' end as action""",
            f"user_id + if(event_id % 3 = 0, 0, {self.customers}) as target_id",
            "concat('Dock ', cast(event_id % 700 as string)) as line1",
            "if(event_id % 3 <> 0, concat('Floor ', cast(event_id % 40 as string)), null) as line2",
            "'City' as city",
            "concat('P', cast(event_id % 10 as string)) as province",
            "lpad(cast(event_id as string), 5, '0') as post",
            "'Land' as country",
            "lpad(cast((event_id * 7919) % 10000000 as string), 16, '0') as card_number",
            "if(event_id % 17 = 0, 'soon', cast(2025 + event_id % 6 as string)) as exp_year",
            "cast(event_id % 14 as string) as exp_month",
            "concat('Holder ', cast(user_id as string)) as card_holder",
            "user_id as address_id",
        )
        return forms

    @property
    def payment_forms(self) -> DataFrame:
        """Payment forms from sign-ups; the card numbers are made up from the event number."""
        return self.raw("events").filter("event_type = 'signup'").selectExpr(
            "event_id as payment_id",
            "user_id as customer_id",
            "lpad(cast((event_id * 7919) % 10000000 as string), 16, '0') as card_number",
            "if(event_id % 17 = 0, 'soon', cast(2025 + event_id % 6 as string)) as exp_year",
            "if(event_id % 29 = 0, 'x', cast(event_id % 14 as string)) as exp_month",
            "concat('Holder ', cast(user_id as string)) as card_holder",
            f"event_id % {self.customers} as address_id",
        )

    @property
    def payment_removals(self) -> DataFrame:
        """Removals of own payment methods and attempts on other customers' ones."""
        return self.raw("events").filter("event_type = 'error'").selectExpr(
            "event_id as seq",
            "user_id as customer_id",
            "'remove_payment' as action",
            f"if(event_id % 2 = 0, user_id, event_id % {self.customers}) as target_id",
        )

    @property
    def registrations(self) -> DataFrame:
        """Registration forms; homes N25 and N26 are not airports."""
        return self.raw("customer").selectExpr(
            "1000000000 + c_custkey as customer_id",
            "2000000000 + c_custkey as address_id",
            "c_name as name",
            "concat(lower(c_name), '@example.org') as email",
            "concat('Unit ', cast(c_custkey % 500 as string)) as addr",
            "c_mktsegment as city",
            "concat('P', cast(c_custkey % 10 as string)) as province",
            "lpad(cast(c_custkey as string), 5, '0') as post",
            f"{_node('c_nationkey')} as country",
            f"{_node('c_custkey % 27')} as home",
        )

    @property
    def address_forms(self) -> DataFrame:
        """New-address forms, every third one without a second line."""
        return self.raw("customer").selectExpr(
            "c_custkey as customer_id",
            "3000000000 + c_custkey as address_id",
            "concat('Dock ', cast(c_custkey % 700 as string)) as line1",
            "if(c_custkey % 3 <> 0, concat('Floor ', cast(c_custkey % 40 as string)), null) as line2",
            "c_mktsegment as city",
            "concat('P', cast(c_custkey % 10 as string)) as province",
            "lpad(cast(c_custkey as string), 5, '0') as post",
            f"{_node('c_nationkey')} as country",
        )

    @property
    def tags(self) -> DataFrame:
        """Booking tags, two flights each; every ninth has its class quoted, some are broken."""
        cabin = "1 + o_orderkey % 4"
        quoted = f"""if(o_orderkey % 9 = 0, concat('"', {cabin}, '"'), cast({cabin} as string))"""
        return self.raw("orders").selectExpr(
            "o_orderkey as cart_id",
            "o_custkey as customer_id",
            f"""case when o_orderkey % 31 = 0 then concat('[[', o_orderkey, ']]')
                when o_orderkey % 37 = 0 then 'none'
                else concat('[[', o_orderkey, ', ', {quoted}, '], [', o_orderkey + 1, ', ', {quoted}, ']]')
                end as tag""",
        )

    @property
    def dirty_tables(self) -> dict[str, DataFrame]:
        """The tables with faults worked in for the integrity checks."""
        customers = self.raw("customer").selectExpr(
            "if(c_custkey % 50 = 0, abs(c_custkey - 1), c_custkey) as id",
            "if(c_custkey % 41 <> 0, c_name, null) as name",
            "concat(c_name, '@Example.com') as email",
            "if(c_custkey % 7 <> 0, c_custkey, null) as primary_payment_id",
            "c_custkey as primary_address_id",
            f"if(c_custkey % 100 = 0, 'N7', {_node('c_custkey % 27')}) as primary_airport_id",
        )
        refund = self.raw("region").filter("r_regionkey = 0").selectExpr(
            "9 as id", "r_name as display_name", "cast(-1 as decimal(19,2)) as fee"
        )
        repeated = self.schedule.filter("id % 97 = 0").selectExpr("* except (id)", "id + 1000000000 as id")
        payments = self.payments.selectExpr(
            "* except (billing_address)", "if(id % 43 <> 0, billing_address, null) as billing_address"
        )
        return {
            "customer": customers,
            "address": self.addresses.filter("id % 60 <> 0"),
            "airport": self.airports,
            "airline": self.airlines.filter("callsign <> 'R4'"),
            "flight": self.flights,
            "flight_schedule": self.schedule.unionByName(repeated),
            "class": self.classes.unionByName(refund),
            "payment_method": payments,
            "ticket": self.tickets.selectExpr(
                "* except (class_id)", "if(id % 500 = 0, 7, class_id) as class_id"
            ),
            "flight_class": self.fares.selectExpr(
                "* except (capacity)", "if(flight_id % 90 <> 0, capacity, null) as capacity"
            ),
            "customer_address": self.address_links,
        }
