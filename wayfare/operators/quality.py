"""Keys and constraints checked as jobs over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRIMARY_KEYS = {
    "customer": ["id"],
    "address": ["id"],
    "airport": ["iata"],
    "airline": ["callsign"],
    "flight": ["id"],
    "flight_schedule": ["id"],
    "class": ["id"],
    "payment_method": ["id"],
    "ticket": ["id"],
    "flight_class": ["flight_id", "class_id"],
    "customer_address": ["customer_id", "address_id"],
}

REQUIRED = {
    "customer": ["id", "name", "email", "primary_airport_id"],
    "address": ["id", "line_1", "line_2", "city", "country"],
    "airport": ["iata", "name", "lat", "long", "city", "country", "tz"],
    "airline": ["callsign", "name", "country"],
    "flight": [
        "id", "airline", "number", "departure_time", "arrival_time", "duration",
        "departure_airport", "arrival_airport",
    ],
    "flight_schedule": [
        "id", "airline", "number", "valid_from", "valid_to", "departure_airport", "departure_min",
        "arrival_airport", "arrival_min", "days", "leg", "duration",
    ],
    "class": ["id", "display_name", "fee"],
    "payment_method": ["id", "exp", "card_holder", "billing_address", "customer_id"],
    "ticket": ["id", "price", "leg", "flight", "customer_id", "paid_with", "class_id"],
    "flight_class": ["flight_id", "class_id", "capacity"],
    "customer_address": ["customer_id", "address_id"],
}

# child table, column, parent table, parent key
FOREIGN_KEYS = [
    ("customer", "primary_payment_id", "payment_method", "id"),
    ("customer", "primary_address_id", "address", "id"),
    ("customer", "primary_airport_id", "airport", "iata"),
    ("flight", "airline", "airline", "callsign"),
    ("flight", "departure_airport", "airport", "iata"),
    ("flight", "arrival_airport", "airport", "iata"),
    ("payment_method", "billing_address", "address", "id"),
    ("payment_method", "customer_id", "customer", "id"),
    ("ticket", "flight", "flight", "id"),
    ("ticket", "customer_id", "customer", "id"),
    ("ticket", "paid_with", "payment_method", "id"),
    ("ticket", "class_id", "class", "id"),
    ("flight_class", "flight_id", "flight", "id"),
    ("flight_class", "class_id", "class", "id"),
    ("customer_address", "customer_id", "customer", "id"),
    ("customer_address", "address_id", "address", "id"),
]

# table, column, length
CODE_LENGTHS = [
    ("airport", "iata", 3),
    ("customer", "primary_airport_id", 3),
    ("flight", "departure_airport", 3),
    ("flight", "arrival_airport", 3),
    ("flight_schedule", "departure_airport", 3),
    ("flight_schedule", "arrival_airport", 3),
    ("airline", "callsign", 2),
    ("flight", "airline", 2),
    ("flight_schedule", "airline", 2),
]

SCHEDULE_UNIQUE = [
    "airline", "number", "valid_from", "valid_to", "departure_airport", "departure_min",
    "arrival_airport", "arrival_min",
]


def _report(df: DataFrame, rule: str, table: str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(table).alias("table"), "key", "violations")


def duplicate_keys(df: DataFrame, table: str, keys: list[str], rule: str = "primary key") -> DataFrame:
    """Keys held by more than one row. ``violations`` is the number of such rows."""
    text = F.concat_ws(",", *[F.col(k).cast("string") for k in keys])
    counted = df.groupBy(*keys).agg(F.count("*").alias("violations")).filter(F.col("violations") > 1)
    return _report(counted.withColumn("key", text), rule, table)


def row_rules(df: DataFrame, table: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rows breaking each of ``rules`` (rule, key, SQL condition for a broken row), all counted in
    one pass over the table. Rules nobody breaks give no row."""
    counts = df.agg(*[F.count_if(F.expr(broken)).alias(f"n{i}") for i, (_, _, broken) in enumerate(rules)])
    named = ", ".join(
        f"struct('{rule}' as rule, '{key}' as key, n{i} as violations)" for i, (rule, key, _) in enumerate(rules)
    )
    found = counts.selectExpr(f"inline(array({named}))").filter("violations > 0")
    return found.select("rule", F.lit(table).alias("table"), "key", "violations")


def orphans(child: DataFrame, table: str, links: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Values of the child's ``links`` (column, parent, parent key) without a parent row.

    All columns are checked in one pass. NULL counts as no reference. The values are counted
    before the join, so a value shared by many rows travels once.
    """
    values = ", ".join(f"struct('{c}' as _column, cast({c} as string) as _value)" for c, _, _ in links)
    used = child.selectExpr(f"inline(array({values}))").filter("_value is not null")
    counted = used.groupBy("_column", "_value").agg(F.count("*").alias("violations"))
    known = reduce(
        DataFrame.unionByName,
        [p.selectExpr(f"'{c}' as _column", f"cast({key} as string) as _value") for c, p, key in links],
    )
    missing = counted.join(known, ["_column", "_value"], "left_anti")
    return _report(missing.withColumn("key", F.concat("_column", F.lit("="), "_value")), "foreign key", table)


def primary_key_report(tables: dict[str, DataFrame]) -> DataFrame:
    return _union(duplicate_keys(tables[t], t, keys) for t, keys in PRIMARY_KEYS.items() if t in tables)


def foreign_key_report(tables: dict[str, DataFrame]) -> DataFrame:
    links: dict[str, list] = {}
    for child, column, parent, key in FOREIGN_KEYS:
        if child in tables and parent in tables:
            links.setdefault(child, []).append((column, tables[parent], key))
    return _union(orphans(tables[child], child, found) for child, found in links.items())


def _not_null_rules(table: str, df: DataFrame) -> list[tuple[str, str, str]]:
    return [("not null", c, f"{c} is null") for c in REQUIRED.get(table, []) if c in df.columns]


def _domain_rules(table: str) -> list[tuple[str, str, str]]:
    rules = [("code length", c, f"length({c}) <> {n}") for t, c, n in CODE_LENGTHS if t == table]
    if table == "class":
        rules.append(("fee not negative", "fee", "fee < 0"))
    return rules


def not_null_report(tables: dict[str, DataFrame]) -> DataFrame:
    return _union(row_rules(df, t, _not_null_rules(t, df)) for t, df in tables.items())


def unique_timetable(schedule: DataFrame) -> DataFrame:
    """Repeated timetable entries. Only equal ranges count: one flight number may have
    overlapping ranges. An entry with a missing value equals no other."""
    return duplicate_keys(schedule.dropna(subset=SCHEDULE_UNIQUE), "flight_schedule", SCHEDULE_UNIQUE, "unique timetable entry")


def domain_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Code lengths, the class fee and the timetable's uniqueness rule."""
    parts = [row_rules(df, t, _domain_rules(t)) for t, df in tables.items() if _domain_rules(t)]
    if "flight_schedule" in tables:
        parts.append(unique_timetable(tables["flight_schedule"]))
    return _union(parts)


def integrity_report(tables: dict[str, DataFrame]) -> DataFrame:
    """All rules over the given tables: rule, table, key, violations. Empty means clean.

    Each table is read once for its row rules, once for its key and once for its references.
    """
    if not tables:
        raise ValueError("no table to check")
    parts = [row_rules(df, t, _not_null_rules(t, df) + _domain_rules(t)) for t, df in tables.items()]
    if "flight_schedule" in tables:
        parts.append(unique_timetable(tables["flight_schedule"]))
    return _union([primary_key_report(tables), foreign_key_report(tables), *parts])


def _union(parts) -> DataFrame | None:
    parts = [p for p in parts if p is not None]
    return reduce(DataFrame.unionByName, parts) if parts else None
