"""Streams that land in logs the batch operators read.

A log is the table ``log`` of a store: every micro-batch is committed under its number, so a retried one
changes nothing and a killed one leaves nothing. The current state is the batch operator applied to
the log, so stream and batch cannot disagree, no state is keyed to one task, and a busy customer is
reduced before its shuffle. Settled batches are rewritten as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from wayfare.operators.cart import cart_state, reduce_cart_events
from wayfare.sources.manifest import Store, Version

EVENT = "seq bigint, customer_id bigint, action string, flight_id bigint, class_id int"

_NO_TRIGGER = {"availableNow": True}


LOG = "log"


def start_log(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    reduce: Callable[[DataFrame], DataFrame] = lambda batch: batch,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write each micro-batch of ``stream``, after ``reduce``, to the log at ``path``."""
    store = Store(stream.sparkSession, path)

    def land(batch: DataFrame, batch_id: int) -> None:
        # A stream begun anew, from another checkpoint, numbers its batches anew.
        store.append({LOG: reduce(batch)}, f"{LOG}@{checkpoint}", batch_id)

    return (
        stream.writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or _NO_TRIGGER))
        .start()
    )


def read_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of all committed batches of a log."""
    return Store(spark, path).read(LOG, schema)


# -- carts ------------------------------------------------------------------


def start_cart_log(
    events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Keep the reduced cart events of each micro-batch. The carts are ``cart_state`` of the log."""
    return start_log(events, path, checkpoint, reduce_cart_events, trigger)


def rewrite_cart_log(spark: SparkSession, path: str, leave: int = 0, settled_seq: int | None = None) -> Version:
    """Rewrite all batches of a cart log but the newest ``leave`` as one, which has only what can still matter."""
    schema = reduce_cart_events(spark.createDataFrame([], EVENT)).schema
    return Store(spark, path).compact(LOG, schema, leave, lambda log: compact_cart_log(log, settled_seq))


def compact_cart_log(log: DataFrame, settled_seq: int | None = None) -> DataFrame:
    """An equivalent, shorter log: the surviving adds and the newest clears and removals.

    Clears and removals only matter to adds that may still arrive late. Those up to
    ``settled_seq``, below which no event is outstanding, are dropped.
    """
    marks = reduce_cart_events(log.filter(F.col("action") != "add"))
    if settled_seq is not None:
        marks = marks.filter(F.col("seq") > settled_seq)
    adds = cart_state(log).withColumn("action", F.lit("add"))
    return marks.unionByName(adds.select(*marks.columns))


# -- accounts ---------------------------------------------------------------


def start_account_log(
    changes: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Keep the account changes. The tables are ``apply_changes(base, log)``; ``accounts.merge_log`` folds
    the batches into snapshots."""
    return start_log(changes, path, checkpoint, trigger=trigger)
