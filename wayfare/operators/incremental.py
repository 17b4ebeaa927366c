"""Integrity of tables that grow by partitions, checked without reading them again.

What is known of a table is kept small: for every key a set of its numbers as bitmaps, the keys that are
held more than once with their rows, and the references that have no parent yet with theirs. A new
partition is checked against these and merged into them; the tables themselves are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions import bitmaps
from wayfare.operators.quality import FOREIGN_KEYS, PRIMARY_KEYS

#: Primary keys of more than one column as one number: SQL, and what must hold for it to be one.
COMPOSITE = {
    "flight_class": ("flight_id * 256 + class_id", "class_id between 0 and 255 and flight_id between 0 and 36028797018963967"),
}

KEYS = f"table string, {bitmaps.SCHEMA}"
REPEATED = "table string, key string, violations bigint"
ORPHANS = "table string, column string, value bigint, violations bigint"


@dataclass
class Known:
    """``keys``: bitmaps by table; ``repeated``: keys held more than once; ``orphans``: references
    without a parent."""

    keys: DataFrame
    repeated: DataFrame
    orphans: DataFrame

    @staticmethod
    def nothing(spark: SparkSession) -> Known:
        return Known(*[spark.createDataFrame([], s) for s in (KEYS, REPEATED, ORPHANS)])


def _number(table: str) -> str:
    """SQL for a table's primary key as one number."""
    columns = PRIMARY_KEYS[table]
    if len(columns) == 1:
        return columns[0]
    if table not in COMPOSITE:
        raise ValueError(f"the key of {table} is no number")
    number, fits = COMPOSITE[table]
    return f"case when {fits} then {number} else raise_error('key of {table} too large') end"


def add_partition(known: Known, table: str, rows: DataFrame) -> Known:
    """What is known after a partition of a table. Only ``rows`` and the bitmaps of its keys, of its parents
    and of its own earlier partitions are read. Keys are whole numbers; NULLs are no keys and no
    references."""
    key, columns = _number(table), PRIMARY_KEYS[table]
    shown = F.concat_ws(",", *[F.col(c).cast("string") for c in columns])
    held = known.keys.where(F.col("table") == table).select("bucket", "bits")

    counted = rows.where(" and ".join(f"{c} is not null" for c in columns)).groupBy(F.expr(key).alias("number"))
    counted = counted.agg(F.count("*").alias("n"), F.min(shown).alias("key"))
    counted = bitmaps.marked(counted, "number", held, "earlier")
    # A key that is held already and not yet among the repeated ones has one row so far.
    again = counted.where("earlier or n > 1").select("key", "n", "earlier")
    before = known.repeated.where(F.col("table") == table).select("key", F.col("violations").alias("so_far"))
    again = again.join(before, "key", "left").select(
        F.lit(table).alias("table"),
        "key",
        (F.col("n") + F.coalesce("so_far", F.col("earlier").cast("bigint"))).alias("violations"),
    )
    kept = known.repeated.join(again.select("table", "key"), ["table", "key"], "left_anti")

    new = bitmaps.bitmaps(counted, "number").withColumn("table", F.lit(table)).select("table", "bucket", "bits")
    keys = bitmaps.merged(known.keys.unionByName(new), "table")

    # References that this partition brings, and earlier ones to what it brings.
    missing = known.orphans
    for child, column, parent, _ in FOREIGN_KEYS:
        if child == table and len(PRIMARY_KEYS[parent]) == 1 and dict(rows.dtypes)[column] in ("int", "bigint"):
            used = rows.where(f"{column} is not null").groupBy(F.col(column).cast("bigint").alias("value"))
            used = used.agg(F.count("*").alias("violations"))
            parents = keys.where(F.col("table") == parent).select("bucket", "bits")
            found = bitmaps.marked(used, "value", parents, "known").where("not known")
            missing = missing.unionByName(found.select(F.lit(table).alias("table"), F.lit(column).alias("column"), "value", "violations"))
    missing = missing.groupBy("table", "column", "value").agg(F.sum("violations").alias("violations"))
    own = keys.where(F.col("table") == table).select("bucket", "bits")
    points_here = F.lit(False)
    for child, column, parent, _ in FOREIGN_KEYS:
        if parent == table:
            points_here = points_here | ((F.col("table") == child) & (F.col("column") == column))
    told = bitmaps.marked(missing, "value", own, "known").withColumn("here", points_here)
    orphans = told.where("not (here and known)").drop("here", "known")
    return Known(keys, kept.unionByName(again), orphans)


def report(known: Known) -> DataFrame:
    """rule, table, key, violations: as ``quality`` reports keys and references of the whole tables."""
    keys = known.repeated.select(F.lit("primary key").alias("rule"), "table", "key", "violations")
    links = known.orphans.select(
        F.lit("foreign key").alias("rule"), "table", F.concat("column", F.lit("="), F.col("value").cast("string")).alias("key"), "violations"
    )
    return keys.unionByName(links)
