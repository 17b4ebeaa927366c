"""New keys without gaps for rows that arrive in runs.

A run's rows are sorted over all tasks and take the numbers after the last one given out: Spark's range
partitioning cuts the order into slices, and a row's number is the sizes of the slices before its own, one
small row each, and its place within it. The keys of a run are kept in a store, so a run that is repeated
gets the ones it had, and a killed run has taken none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wayfare.session import stage
from wayfare.sources.manifest import Conflict, Store

_LAST = "last"


def dense_numbers(rows: DataFrame, order: list[str], out: str, first: int = 1) -> DataFrame:
    """``rows`` numbered without gaps from ``first``, by ``order`` (NULLs last), which tells them apart."""
    by = [F.col(c).asc_nulls_last() for c in order]
    # Staged before, since range partitioning reads its input twice, and after, since places must not change.
    placed = stage(rows, "to-number").repartitionByRange(*by).sortWithinPartitions(*by)
    placed = stage(placed.withColumn("_at", F.monotonically_increasing_id()), "in-order")
    placed = placed.withColumn("_slice", F.shiftright("_at", 33))
    # As many rows as the sort has partitions.
    slices = placed.groupBy("_slice").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    starts = slices.select("_slice", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(starts), "_slice").select(*rows.columns, (F.col("_before") + place + F.lit(first)).alias(out))


def allocate(store: Store, rows: DataFrame, order: list[str], run: str, out: str = "id") -> DataFrame:
    """``rows`` of a run with a new key ``out`` each, the same ones whenever the run is repeated.

    Keys follow those of the runs before, in any order of runs. Of runs that begin at the same time one
    after the other gets its keys.
    """
    table = f"keys-{run}"
    schema = StructType([*rows.schema.fields, StructField(out, LongType())])
    while True:
        version = store.latest()
        if version.has(run):
            return store.read(table, schema, version)
        last = version.done.get(_LAST, 0)
        folder = store.write(dense_numbers(rows, order, out, last + 1), table)
        given = store.read_folders([folder], schema).count()
        try:
            store.commit(version, {table: [folder]}, {run: 0, _LAST: last + given})
        except Conflict:
            continue


def last_key(store: Store) -> int:
    """The largest key given out; 0 before the first."""
    return store.latest().done.get(_LAST, 0)
