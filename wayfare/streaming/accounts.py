"""Account changes as a stream, merged into snapshots in the same store.

The log's batches stand in the store beside the snapshots of the account tables. A merge reads the snapshots
and the batches that came since, and puts the new snapshots in their place in one version, so that a merge
that is killed has not happened and one that is repeated finds nothing left to merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from wayfare.operators import snapshots
from wayfare.sources.manifest import Store, Version
from wayfare.streaming.feeds import LOG


def start_store(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> Version:
    """Put the account tables into a new store. Done twice, it changes nothing."""
    first = snapshots.first_snapshot(tables)
    if "payment_method" in tables:
        first["refused_payment"] = spark.createDataFrame([], snapshots.REFUSED)
    return Store(spark, path).append(first, "base")


def _snapshots(store: Store, version: Version) -> dict[str, DataFrame]:
    return {t: store.read(t, snapshots.snapshot_schema(t), version) for t in snapshots.TABLES if t in version.tables}


def merge_log(spark: SparkSession, path: str, log_schema: StructType, settled_seq: int | None = None) -> Version:
    """Merge the batches that stand in the log into the snapshots, and take them out of it."""
    store = Store(spark, path)
    before = store.latest()
    batches = before.tables.get(LOG, [])
    if not batches:
        return before
    merged = snapshots.merge(_snapshots(store, before), store.read_folders(batches, log_schema), settled_seq)
    return store.replace(before, {LOG: len(batches), **{t: 1 for t in merged}}, merged)


def read_accounts(spark: SparkSession, path: str, log_schema: StructType) -> dict[str, DataFrame]:
    """The account tables as they are now: the snapshots with the batches that are not merged yet."""
    store = Store(spark, path)
    version = store.latest()
    now = snapshots.merge(_snapshots(store, version), store.read_folders(version.tables.get(LOG, []), log_schema))
    return snapshots.current(now)
